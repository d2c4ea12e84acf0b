"""Partition refresh, shards with differing columns, expectations in one pass."""

import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from demandlab.operators import expectations as X
from demandlab.operators.quality import DataQualityError
from demandlab.plans import refresh
from demandlab.sources.external import read_shards
from demandlab.sources.files import refresh_partitions
from demandlab.sources.tables import Tables


def test_refresh_replaces_only_its_partitions(spark):
    path = tempfile.mkdtemp(prefix="demandlab-test-") + "/t"
    kind = "k int, v string, week date"
    day = lambda n: dt.date(2020, 5, n)
    refresh_partitions(spark.createDataFrame([(1, "old", day(2)), (2, "old", day(9)), (3, "old", day(9)), (4, "old", None)], kind), path, ["week"])
    kept = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/week=2020-05-02/*.parquet")}
    refresh_partitions(spark.createDataFrame([(2, "new", day(9)), (5, "new", day(16))], kind), path, ["week"], expected=["k", "v", "week"])
    got = sorted(map(tuple, spark.read.schema(kind).parquet(path).collect()))
    assert got == [(1, "old", day(2)), (2, "new", day(9)), (4, "old", None), (5, "new", day(16))]  # row 3 went with its week
    assert kept and kept == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/week=2020-05-02/*.parquet")}
    with pytest.raises(ValueError, match="extra"):
        refresh_partitions(spark.createDataFrame([(1, "x", day(2), 1)], kind + ", extra int"), path, ["week"], expected=["k", "v", "week"])
    refresh_partitions(spark.createDataFrame([], kind), path, ["week"])  # nothing delivered: nothing replaced
    assert spark.read.schema(kind).parquet(path).count() == 4


def test_refreshed_table_differs_from_its_first_load(spark):
    root = tempfile.mkdtemp(prefix="demandlab-test-")
    out = refresh.refreshed_sales(Tables(spark, SF_SMALL), root)
    files = glob.glob(f"{root}/sales/*/*.parquet")
    weeks = {os.path.basename(os.path.dirname(f)) for f in files}
    assert len(weeks) == out.select("week_ending_date").distinct().count()
    late = {f: os.stat(f).st_mtime_ns for f in files if "1998-04" in f or "1998-03-2" in f}
    early = {f: os.stat(f).st_mtime_ns for f in files if "1998-01" in f}
    assert min(late.values()) > max(early.values())


def test_shards_merge_by_name(spark):
    root = tempfile.mkdtemp(prefix="demandlab-test-")
    spark.createDataFrame([(1, "a")], "k int, x string").write.parquet(f"{root}/one")
    spark.createDataFrame([(2.5, 2)], "y double, k int").write.parquet(f"{root}/two")
    got = {(r.k, r.x, r.y) for r in read_shards(spark, root, merge=True).collect()}
    assert got == {(1, "a", None), (2, None, 2.5)}


ROWS = [(1, "a", 5, dt.date(2020, 1, 3)), (2, None, -1, dt.date(2020, 1, 2)), (2, "c", None, None), (None, "zz", 7, dt.date(2020, 1, 1)),
        (None, "zz", 7, dt.date(2020, 1, 1))]
def checks():
    return [X.not_null("s"), X.between("n", 0, 6), X.one_of("s", ["a", "c"]), X.matches("s", "^.$"), X.holds("n known", F.col("n") > -5),
            X.distinct_values("s", 3), X.distinct_values("s", 4), X.fresh("d", dt.date(2020, 1, 5), 2), X.fresh("d", dt.date(2020, 1, 1), 9),
            X.at_least_rows(5), X.at_least_rows(6), X.unique("k"), X.unique("s", "n")]


def test_report_names_every_violation(spark):
    df = spark.createDataFrame(ROWS, "k int, s string, n int, d date")
    got = {r["check"]: (r.passed, r.violations, r.example) for r in X.report(df, checks(), ["k", "s"], ["k", "s", "n", "d"]).collect()}
    assert got == {
        "columns": (True, 0, None), "s is not null": (False, 1, "2|?"), "n in 0..6": (False, 3, "2|?"), "s is a known value": (False, 2, "?|zz"),
        "s matches ^.$": (False, 2, "?|zz"), "n known": (False, 1, "2|c"), "3 values of s": (True, 0, None), "4 values of s": (False, 1, None),
        "d within 2 days": (True, 0, None), "d within 9 days": (False, 1, None), "at least 5 rows": (True, 0, None), "at least 6 rows": (False, 1, None),
        "k is unique": (False, 2, "2"), "s, n is unique": (False, 1, "zz|7")}
    with pytest.raises(DataQualityError, match="s is not null: 1"):
        X.enforce(df, checks(), ["k", "s"])
    X.enforce(df, [X.at_least_rows(1), X.not_null("s")][:1], ["k"])


def test_report_is_one_pass_and_takes_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "k int, s string, n int, d date")
    rows = [c for c in checks() if not c.unique and not c.table]
    plan = X.report(df, rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and plan.count("ObjectHashAggregate") + plan.count("HashAggregate") <= 6
    empty = {r["check"]: r.passed for r in X.report(df.limit(0), checks(), ["k"]).collect()}
    assert empty["s is not null"] and empty["k is unique"] and not empty["at least 5 rows"] and not empty["3 values of s"]
    assert X.report(df, [], ["k"]).collect() == []


def test_dirty_series_breaks_every_kind_of_check(spark):
    t = Tables(spark, SF_ORACLE)
    failed = [r["check"] for r in X.report(refresh.dirty_daily(t), refresh.daily_checks(), ["state", "date"]).where("NOT passed").collect()]
    assert {"state is not null", "order_value is not null", "state_initial matches ^[A-Z]{2}$", "50 values of state"} <= set(failed)
