import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlab.functions import decay_multiplier, growth, composite_key, key_part, week_ending, month_number
from demandlab.operators.reshape import date_columns, cast_date_columns


def test_week_ending_rules(spark):
    days = [dt.date(2020, 5, 1), dt.date(2020, 5, 2), dt.date(2020, 5, 3), dt.date(2020, 5, 4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select("d", week_ending("d", "next").alias("n"), week_ending("d", "same_or_next").alias("s"),
                     week_ending("d", "monday_week").alias("m")).orderBy("d").collect()
    sat1, sat2 = dt.date(2020, 5, 2), dt.date(2020, 5, 9)
    assert [r.n for r in rows] == [sat1, sat2, sat2, sat2]
    assert [r.s for r in rows] == [sat1, sat1, sat2, sat2]
    assert [r.m for r in rows] == [sat1, sat1, sat1, sat2]
    with pytest.raises(ValueError):
        week_ending("d", "bogus")


def test_iso_week_year_and_double_cast(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), "12.345")], "date_col timestamp, dbl_col string")
    r = df.select(F.weekofyear("date_col").alias("w"), F.year("date_col").alias("y"),
                  F.col("dbl_col").cast("double").alias("x")).first()
    assert (r.w, r.y, r.x) == (1, 2020, 12.345)
    assert isinstance(df.select(F.col("dbl_col").cast("double")).schema.fields[0].dataType, T.DoubleType)


def test_decay_ladder(spark):
    vals = [-0.01, 0.0, 0.5, 0.51, 1.0, 1.01, 5.0, 5.01, 10.0, 10.01, None]
    want = [0.8, 0.2, 0.2, 0.15, 0.15, 0.1, 0.1, 0.08, 0.08, 0.05, 0.05]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, g double")
    got = [r.m for r in df.select("i", decay_multiplier("g").alias("m")).orderBy("i").collect()]
    assert got == want


def test_growth_null_on_zero_or_missing(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, None), (3, 15.0, 10.0)], "i int, ty double, ly double")
    got = [r.g for r in df.select("i", growth("ty", "ly").alias("g")).orderBy("i").collect()]
    assert got == [None, None, 0.5]


def test_composite_key_keeps_null_positions(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    r = df.select(composite_key("x", "y", "z").alias("k")).first()
    assert r.k == "a_None_c"
    assert df.select(key_part(composite_key("x", "y", "z"), 2).alias("p")).first().p == "c"


def test_month_number(spark):
    df = spark.createDataFrame([("January",), ("June",), ("December",), ("Nope",)], "m string")
    assert [r.n for r in df.select(month_number("m").alias("n")).collect()] == [1, 6, 12, None]


def test_date_token_columns(spark):
    yes = ["date", "DATE", "this_is_a_dAtE"]
    no = ["note a daate", "mandate", "datewrong", "innerdateinner", "1date1", "%date%"]
    assert date_columns(yes + no) == yes
    df = spark.createDataFrame([("2020-01-01", "2020-01-02", "x")], "date string, this_is_a_dAtE string, mandate string")
    out = cast_date_columns(df)
    types = {f.name: f.dataType for f in out.schema.fields}
    assert isinstance(types["date"], T.TimestampType) and isinstance(types["this_is_a_dAtE"], T.TimestampType)
    assert isinstance(types["mandate"], T.StringType)
