import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from demandlab.sources.files import (flatten_series_response, latest_file_read, overwrite_table, read_column_contract,
                                     read_csv, write_column_contract, write_stage)
from demandlab.sources.tables import strip_column_prefix


def _scratch():
    return tempfile.mkdtemp(prefix="demandlab-test-")


def test_latest_file_read_keeps_newest_file_only(spark):
    d = _scratch()
    old, new = os.path.join(d, "a_old.csv"), os.path.join(d, "b_new.csv")
    with open(old, "w") as f:
        f.write("state,v\nX,1\nY,2\n")
    with open(new, "w") as f:
        f.write("state,v\nZ,3\n")
    now = time.time()
    os.utime(old, (now - 3600, now - 3600))
    os.utime(new, (now, now))
    rows = latest_file_read(spark, d, "csv", schema="state string, v int").collect()
    assert [(r.state, r.v) for r in rows] == [("Z", 3)]


def test_read_csv_with_schema_and_bom(spark):
    d = _scratch()
    p = os.path.join(d, "names.csv")
    with open(p, "wb") as f:
        f.write("﻿state,state_initial\r\nAlabama,AL\r\nAlaska,AK\r\n".encode("utf-8"))
    df = read_csv(spark, p, "state string, state_initial string")
    assert sorted((r.state, r.state_initial) for r in df.collect()) == [("Alabama", "AL"), ("Alaska", "AK")]


def test_flatten_series_response(spark):
    ok = {"status": "REQUEST_SUCCEEDED", "Results": {"series": [{"data": [
        {"year": "2020", "period": "M04", "periodName": "April", "latest": "true", "value": "270.1", "footnotes": [{}]},
        {"year": "2020", "period": "M03", "periodName": "March", "value": "268.5", "footnotes": [{}]}]}]}}
    bad = {"status": "REQUEST_FAILED", "Results": {"series": []}}
    df = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bad),)], "value string")
    rows = flatten_series_response(df).orderBy("period").collect()
    assert [(r.period, r.value) for r in rows] == [("M03", "268.5"), ("M04", "270.1")]


def test_overwrite_table_and_column_contract(spark):
    d = _scratch()
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    overwrite_table(df, "demandlab_test_tbl", path=os.path.join(d, "tbl"))
    overwrite_table(df.withColumn("k", F.col("k") + 1), "demandlab_test_tbl", path=os.path.join(d, "tbl"))
    assert [r.k for r in spark.table("demandlab_test_tbl").collect()] == [2]
    spark.sql("DROP TABLE IF EXISTS demandlab_test_tbl")
    write_column_contract(spark, df, os.path.join(d, "contract"))
    assert read_column_contract(spark, os.path.join(d, "contract")) == ["k", "v"]
    out = write_stage(df, d, "stage1")
    assert spark.read.parquet(out).count() == 1


def test_strip_prefix(spark):
    df = spark.createDataFrame([(1, 2)], "`t.a` int, `t.b` int")
    assert strip_column_prefix(df).columns == ["a", "b"]


def test_external_readers_and_preprocessors(spark):
    import datetime as dt
    from demandlab.sources.external import read_mobility, read_second_case_source
    from demandlab.plans.external import basic_preproc, case_tracking_preproc, mobility_preproc

    d = _scratch()
    mob = os.path.join(d, "mob")
    os.makedirs(mob)
    base = ",".join(f"b{i}" for i in range(6))
    with open(os.path.join(mob, "m.csv"), "w") as f:
        f.write("country_region_code,country_region,sub_region_1,sub_region_2,census_fips_code,date,"
                "retail_and_recreation_percent_change_from_baseline,grocery_and_pharmacy_percent_change_from_baseline,"
                "parks_percent_change_from_baseline,transit_stations_percent_change_from_baseline,"
                "workplaces_percent_change_from_baseline,residential_percent_change_from_baseline\n")
        f.write("US,United States,Ohio,,,2020-04-01,-10,5,1,2,3,4\n")
        f.write("US,United States,Ohio,Franklin County,39049,2020-04-01,-1,1,1,1,1,1\n")
    m = mobility_preproc(read_mobility(spark, mob))
    assert m.count() == 1 and "sub_region_2" not in m.columns

    geo = spark.createDataFrame([("Ohio", "OH"), ("Texas", "TX")], "state string, state_initial string")
    raw = spark.createDataFrame([(0, "OH", "US", 1, "2020-04-01"), (1, "ZZ", "US", 2, "2020-04-02"),
                                 (2, "TX", "CA", 3, "2020-04-03"), (3, "TX", "US", 35, "2020-04-04")],
                                "V1 int, st string, country string, location_id int, `report date` string")
    out = basic_preproc(raw, geo, "st", "country", "US", exclude_location_id=35)
    rows = out.collect()
    assert [(r.state, r.state_initial) for r in rows] == [("Ohio", "OH")]
    assert "V1" not in out.columns and "report_date" in out.columns
    assert rows[0].report_date == dt.date(2020, 4, 1)

    ct = spark.createDataFrame([("2020-04-01", "OH", 5, "x", 9, "2020-04-02 10:00"),
                                ("2020-04-02", "OH", 7, "y", 9, "2020-04-03 10:00")],
                               "date string, state string, positiveIncrease long, hash string, total long, "
                               "lastUpdateEt string")
    pre, fresh = case_tracking_preproc(ct, dt.date(2020, 4, 10))
    assert set(pre.columns) == {"date", "positiveIncrease", "lastUpdateEt"}
    assert fresh.first().lag_days == 7

    sc = os.path.join(d, "sc")
    os.makedirs(sc)
    with open(os.path.join(sc, "s.csv"), "w") as f:
        f.write("date,state,cases,deaths\n2020-04-01,Ohio,10,1\n")
    assert set(read_second_case_source(spark, sc).columns) == {"date", "state", "src2_cases", "src2_deaths"}


def test_bucketed_ledger_join_has_no_exchange(spark):
    from demandlab.sources.layout import bucket_ledger
    d = _scratch()
    bucket_ledger(spark, "/root/testdata/sf0.001", "demandlab_bkt", 4, d)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        li, od = spark.table("demandlab_bkt.lineitem"), spark.table("demandlab_bkt.orders")
        j = li.join(od, li.l_orderkey == od.o_orderkey)
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP DATABASE IF EXISTS demandlab_bkt CASCADE")
