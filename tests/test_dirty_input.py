"""Dirty landed input, NULLs, changed files, and branches that must be reached."""

import dataclasses
import datetime as dt
import json
import os
import shutil
import tempfile
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from demandlab.config import DEFAULT_CONFIG as CFG
from demandlab.operators.quality import CoverageError, DataQualityError, assert_coverage
from demandlab.plans import external, forecast, ledger, report, series
from demandlab.session import Run
from demandlab.sources import external as readers
from demandlab.sources.files import flatten_series_response, latest_file_read, newest_file, read_csv
from demandlab.sources.tables import Tables


def scratch(name="x"):
    return os.path.join(tempfile.mkdtemp(prefix="demandlab-test-"), name)


def write(path, text, age=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    t = 1_600_000_000 - age
    os.utime(path, (t, t))


# ------------------------------------------------------------------ files ----

def test_csv_columns_are_checked_by_name(spark):
    d = scratch("drop")
    write(f"{d}/a.csv", "date,state,deaths,cases\n2020-04-01,Ohio,7,1000\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_second_case_source(spark, d).collect()
    bad = scratch("bad")
    write(f"{bad}/a.csv", "date,state,cases,deaths\n2020-04-01,Ohio,many,1\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_csv(spark, bad, readers.SECOND_CASE_SCHEMA).collect()


def test_one_newest_file_also_under_ties(spark):
    d = scratch("drop")
    write(f"{d}/a.csv", "k\n1\n")
    write(f"{d}/b.csv", "k\n1\n")
    write(f"{d}/old.csv", "other header\nx\n", age=100)
    assert newest_file(spark, d).endswith("b.csv")
    assert latest_file_read(spark, d, "csv", "k int").count() == 1
    with pytest.raises(FileNotFoundError):
        newest_file(spark, d, "*.json")


def test_projection_table_of_the_newest_drop(spark):
    d = scratch("drops")
    head = "location_name,location_id,date,deaths_mean,deaths_lower,deaths_upper,new_pop_affected\n"
    write(f"{d}/2020_04_01/projections.csv", head + "Ohio,1,2020-04-01,1,1,1,1\n", age=100)
    write(f"{d}/2020_04_08/projections.csv", head + "Ohio,1,2020-04-08,2,1,3,1\n")
    write(f"{d}/2020_04_08/summary.csv", "x\n1\n")
    rows = readers.read_projection_table(spark, d).collect()
    assert [(r.date, r.deaths_mean) for r in rows] == [(dt.date(2020, 4, 8), 2.0)]


def test_response_without_series(spark):
    docs = [{"status": "REQUEST_SUCCEEDED", "Results": {"series": []}}, {"status": "REQUEST_SUCCEEDED"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in docs], "value string")
    assert flatten_series_response(df).count() == 0


# ------------------------------------------------------- checks and filters ----

@pytest.fixture(scope="module")
def geo(spark):
    return spark.createDataFrame([("Ohio", "OH"), ("Texas", "TX"), ("Iowa", "IA")], "state string, state_initial string")


def test_geo_filter_ignores_null_codes(spark, geo):
    df = spark.createDataFrame([("OH", 1), ("TX", 2), (None, 3), (None, 4), (None, 5)], "st string, v int")
    rows = external.geo_filter(df, geo, "st").collect()
    assert sorted((r.state, r.state_initial, r.v) for r in rows) == [("Ohio", "OH", 1), ("Texas", "TX", 2)]


def test_null_location_id_stays(spark, geo):
    df = spark.createDataFrame([("OH", 35), ("TX", None), ("IA", 4)], "st string, location_id int")
    out = external.basic_preproc(df, geo, "st", exclude_location_id=35)
    assert {r.state for r in out.collect()} == {"Texas", "Iowa"}


def test_geo_validation_runs_all_checks(spark, geo):
    part = spark.createDataFrame([("Ohio", "US"), ("Texas", "US")], "state string, country string")
    with pytest.raises(CoverageError, match="Iowa"):
        external.validate_geo_filter(part, geo, expected_states=2)
    two = spark.createDataFrame([("Ohio", "US"), ("Texas", "US"), ("Iowa", "CA")], "state string, country string")
    with pytest.raises(DataQualityError, match="country"):
        external.validate_geo_filter(two, geo, "country")
    external.validate_geo_filter(two, geo, expected_states=3)


def test_coverage_error_names_every_gap(spark):
    known = spark.createDataFrame([(f"s{i}",) for i in range(30)], "state string")
    with pytest.raises(CoverageError) as e:
        assert_coverage(known.where("state = 's0'"), known, "state")
    assert all(f"'s{i}'" in str(e.value) for i in range(1, 30))


def test_mobility_needs_sub_region(spark):
    cols = ", ".join(f"b{i}_baseline double" for i in range(6))
    with pytest.raises(DataQualityError, match="sub_region_2"):
        external.mobility_preproc(spark.createDataFrame([], f"country_region_code string, {cols}"))
    kept = external.mobility_preproc(spark.createDataFrame([], f"country_region_code string, sub_region_2 string, {cols}"))
    assert "country_region_code" in kept.columns


# ------------------------------------------------------------------- plans ----

def copy_tables(change=None):
    d = scratch("tables")
    shutil.copytree(SF_SMALL, d, copy_function=shutil.copyfile)
    os.chmod(d, 0o755)
    for name, fn in (change or {}).items():
        p = f"{d}/{name}.parquet"
        fn(pd.read_parquet(p)).to_parquet(p, coerce_timestamps="us")
    return d


def test_changed_input_is_seen(spark):
    d = copy_tables()
    before = external.state_daily(Tables(spark, d)).agg(F.sum("n_orders")).first()[0]
    o = pd.read_parquet(f"{d}/orders.parquet").head(100)
    o.to_parquet(f"{d}/orders.parquet", coerce_timestamps="us")
    after = external.state_daily(Tables(spark, d)).agg(F.sum("n_orders")).first()[0]
    assert after == 100 < before


def test_run_is_built_once_and_deleted(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    with Run(spark) as run:
        threads = [threading.Thread(target=lambda: run.table(("r",), build)) for _ in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert run.table(("r",), build).count() == 5 and built == [1]
        folder = run.folder
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    plain = Run(spark, materialized=False)
    assert plain.table(("r",), build).count() == 5 and plain.folder is None


def test_dates_of_all_years_are_kept(spark):
    d = copy_tables({"orders": lambda o: o.assign(o_orderdate=o.o_orderdate + pd.DateOffset(years=3))})
    t = Tables(spark, d)
    o = pd.read_parquet(f"{d}/orders.parquet")
    long = external.wide_to_long_quarters(t)
    assert long.count() == len(o.groupby([o.o_orderpriority, o.o_orderdate.dt.year, o.o_orderdate.dt.quarter]))
    assert external.state_daily(t).agg(F.sum("n_orders")).first()[0] == len(o)
    assert long.agg(F.max("year")).first()[0] == o.o_orderdate.dt.year.max() > 2001


def test_uncovered_state_fails(spark):
    cfg = dataclasses.replace(CFG, projection_from=dt.date(2005, 1, 1), projection_to=dt.date(2005, 3, 1))
    with pytest.raises(Exception, match="no projection for state"):
        forecast.milestone_forecast_pos(Tables(spark, SF_ORACLE), cfg).collect()


def test_year_shift_names_one_week(spark):
    rows = [(dt.date(2000, 1, 1), 52, 2000, "a", 1.0), (dt.date(2000, 12, 30), 52, 2000, "a", 2.0), (dt.date(2001, 12, 29), 52, 2001, "a", 3.0),
            (dt.date(2001, 12, 29), 52, 2001, None, 4.0), (dt.date(2000, 12, 30), 52, 2000, None, 5.0)]
    w = spark.createDataFrame(rows, "week_ending_date date, week_of_year int, year int, k string, qty double").withColumn("dollars", F.col("qty"))
    out = series.year_shift_full_outer(w, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    met = {(r.k, r.week_ending_date, r.stly_qty) for r in out.collect() if r.qty is not None}
    assert met == {("a", dt.date(2000, 1, 1), None), ("a", dt.date(2000, 12, 30), 1.0), ("a", dt.date(2001, 12, 29), 2.0),
                   ("Null_Value", dt.date(2000, 12, 30), None), ("Null_Value", dt.date(2001, 12, 29), 5.0)}


def test_years_meet_at_the_category_grain(spark):
    y = series.yoy_category(Tables(spark, SF_SMALL))
    both = y.where("qty IS NOT NULL AND stly_qty IS NOT NULL")
    assert both.count() > 500 and both.where("category = 'Null_Value'").count() > 50


def test_every_ledger_rule_removes_rows(spark):
    t = Tables(spark, SF_SMALL)
    lost = {r.rule: r.n_removed for r in ledger.ledger_filter_loss(t).collect()}
    assert len(lost) == 6 and min(lost.values()) > 0
    h = ledger.hierarchy_sales(t)
    total = ledger.ledger_lines(t).count()
    assert h.agg(F.sum("n_lines")).first()[0] == total
    assert 0 < h.where("category IS NULL").agg(F.sum("n_lines")).first()[0] < total
    assert ledger.ledger_filtered(t).where("length(material_id) <> 10").count() == 0


def test_zero_rule_is_for_pos_only(spark):
    cols = ("sell_id string, state string, category string, week_ending_date date, common_product int, qty_ty double, qty_ly double, "
            "forecast_quantity double, promo_uplift_new double, state_third_milestone_date date")
    L = CFG.latest_week
    df = spark.createDataFrame([("s", "MIDDLE EAST", "ECONOMY", L + dt.timedelta(days=7), 1, None, 4.0, 5.0, 2.0, L)], cols)
    row = report.apply_ship_corrections(df).first()
    assert (row.forecast_quantity, row.promo_uplift_new) == (5.0, 2.0)


def test_growth_flag_is_reached(spark):
    t = Tables(spark, SF_SMALL)
    low = dataclasses.replace(CFG, high_growth_threshold=-10.0)
    flags = forecast.high_growth_flags(t, low)
    name = next(c for c in flags.columns if "high" in c)
    assert flags.where(F.col(name).cast("int") == 1).count() > 0


def test_fit_of_a_one_week_series(spark):
    rows = spark.createDataFrame([("a", dt.date(1997, 3, 1), 4.0), ("b", dt.date(1997, 3, 1), None)], "sell_id string, week_ending_date date, qty double")
    out = forecast.fourier_forecast(rows)
    assert {(r.sell_id, r.seasonal_forecast) for r in out.collect()} == {("a", 4.0)} and out.count() == CFG.seasonal_horizon_weeks - 1


def test_landed_chain_checks_its_files(spark):
    """File drops -> pipeline stage; a changed header, a doubled key or a clashing column fails."""
    from demandlab import pipeline
    from demandlab.operators.joins import JoinValidationError, ObservedJoins
    from demandlab.plans import landed
    folder, out = scratch("landed"), scratch("out")
    t = Tables(spark, SF_SMALL)
    landed.land_drops(t, folder)
    written = pipeline.run(spark, SF_SMALL, out, stages=["policy_duration"], landed=folder)
    rows = spark.read.parquet(written["landed_master"])
    days = external.state_daily(t)
    assert rows.count() == days.count() and rows.agg(F.sum("src2_cases")).first()[0] == days.agg(F.sum("n_orders")).first()[0]
    assert rows.where("unemployment_rate IS NULL OR price_index IS NULL").count() == 0
    drops, geo = landed.read_drops(spark, folder), external.geography(t)
    for name in ("quarterly", "cases"):  # a doubled key on the right, and on the left side
        checks = ObservedJoins()
        landed.merge_drops(drops | {name: drops[name].unionByName(drops[name])}, geo, checks).collect()
        with pytest.raises(JoinValidationError, match="not unique"):
            checks.verify()
    with pytest.raises(DataQualityError, match="src2_cases"):
        landed.merge_drops(drops | {"quarterly": drops["quarterly"].withColumn("src2_cases", F.lit(1))}, geo, ObservedJoins())
    write(f"{folder}/cases/drop3/new.csv", "date,state,deaths,cases\n2020-04-01,Ohio,7,1000\n", age=-10 ** 9)
    with pytest.raises(Exception, match="(?i)header|schema"):
        landed.landed_master(t, folder).collect()


def test_peak_and_fall(spark):
    """Ties, gaps (days without a row are 0), no fall by the end, a peak on the last day, nulls."""
    from demandlab.plans.milestones import peak_and_fall
    day = lambda n: dt.date(2020, 3, n)
    cfg = dataclasses.replace(CFG, projection_from=day(1), projection_to=day(10))
    rows = ([("tie", day(n), v) for n, v in enumerate([1, 9, 9, 5, 3, 2, 9, 1, 1, 1], 1)]
            + [("gap", day(2), 7), ("gap", day(3), 6), ("gap", day(5), 6)]
            + [("high", day(n), 10 - n % 3) for n in range(1, 11)]
            + [("last", day(n), n) for n in range(1, 11)] + [("edge", day(1), 10)] + [("edge", day(n), 3) for n in range(2, 11)]
            + [("tie", None, 99), (None, day(4), 5)])
    got = {r.state: (r.peak_day, r.peak_value, r.fall_day, r.crossed)
           for r in peak_and_fall(spark.createDataFrame(rows, "state string, date date, value long"), ["state"], cfg).collect()}
    assert got == {"tie": (day(2), 9, day(6), True), "gap": (day(2), 7, day(4), True), "high": (day(3), 10, day(10), False),
                   "last": (day(10), 10, day(10), False), "edge": (day(1), 10, day(10), False), None: (day(4), 5, day(5), True)}


def test_newest_drop_is_a_folder_or_a_file(spark):
    from demandlab.sources.files import newest_drop
    d = scratch("drops")
    write(f"{d}/first/a.csv", "k\n1\n", age=50)
    write(f"{d}/second/x/a.csv", "k\n2\n", age=100)      # one old file beside the newest one: still the same drop
    write(f"{d}/second/b.csv", "k\n3\n")
    write(f"{d}/second/notes.txt", "no data")
    write(f"{d}/third/a.csv", "other header\nx\n", age=10)
    assert newest_drop(spark, d, "*.csv").endswith("/second")
    assert sorted(r.k for r in latest_file_read(spark, d, "csv", "k int", pattern="*.csv").collect()) == [2, 3]
    write(f"{d}/single.csv", "k\n9\n", age=-5)
    assert [r.k for r in latest_file_read(spark, "file://" + d, "csv", "k int", pattern="*.csv").collect()] == [9]
    with pytest.raises(FileNotFoundError):
        newest_drop(spark, d, "*.json")


def test_two_row_header(spark):
    """Blank years are carried right, repeated header rows and blank cells are no data."""
    from demandlab.sources.files import read_two_row_header
    d = scratch("wide")
    head = "file,country,1980,,,,1981,1981\nfile,Country name,q1,q2,Q3,q4,q1,q2\n"
    write(f"{d}/a.csv", head + "f,US,1,2.5,,4,5,\n" + head + "f,,7,,,,, 8 \n")
    got = read_two_row_header(spark, f"{d}/a.csv", 2, "rate")
    assert got.columns == ["file", "Country name", "year", "quarter", "rate"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("f", "US", 1980, "q1", 1.0), ("f", "US", 1980, "q2", 2.5), ("f", "US", 1980, "q4", 4.0), ("f", "US", 1981, "q1", 5.0),
        ("f", None, 1980, "q1", 7.0), ("f", None, 1981, "q2", 8.0)], key=str)
    write(f"{d}/b.csv", "file,country,1980\nfile,Country,total\nf,US,1\n")
    with pytest.raises(ValueError, match="years over quarters"):
        read_two_row_header(spark, f"{d}/b.csv", 2)
    write(f"{d}/c.csv", "file,country,1980\nfile,Country,q1\nf,US,many\n")
    with pytest.raises(Exception, match="(?i)cast"):
        read_two_row_header(spark, f"{d}/c.csv", 2).collect()


def test_series_points_come_from_good_responses(spark):
    docs = external.series_responses(Tables(spark, SF_SMALL))
    assert docs.count() == 5 and docs.where("value LIKE '%REQUEST_FAILED%'").count() == 1 and docs.where("value LIKE '%\"series\":[]%'").count() == 1
    assert external.series_points(Tables(spark, SF_SMALL)).select("series").distinct().count() == 3


def test_checks_need_no_job_of_their_own(spark):
    from demandlab.operators.joins import JoinValidationError, ObservedJoins
    from demandlab.operators.quality import drop_null_keys
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, w int")
    jobs = {}
    for observed in (False, True):
        spark.sparkContext.setJobGroup(f"observed-{observed}", "x")
        if observed:
            checks = ObservedJoins()
            rows, seen = drop_null_keys(left, ["k", "v"])
            rows = checks.join("numbers", rows, right, "k")
        else:
            rows = left.where("k IS NOT NULL AND v IS NOT NULL").join(right, "k", "left")
        rows.write.parquet(scratch())
        jobs[observed] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"observed-{observed}"))
    spark.sparkContext.setJobGroup("none", "x")
    assert seen.get == {"rows": 4, "rejected": 2}
    checks.verify()
    assert checks.metrics(spark).first().asDict() == {"merge": "numbers", "rows_left": 2, "rows_right": 3, "rows_out": 2, "rows_met": 2}
    assert jobs[True] <= jobs[False] + 1  # the window's exchange may run as a stage of its own, no second scan
    for l, r, how in ((left, right.union(right), "m:1"), (left.union(left), right, "1:1"), (left, right, "1:1")):
        bad = ObservedJoins()
        bad.join("x", l, r, "k", how).write.parquet(scratch())
        with pytest.raises(JoinValidationError):
            bad.verify()
