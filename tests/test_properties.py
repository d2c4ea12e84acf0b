import datetime as dt

from hypothesis import given, settings, strategies as st

from demandlab.config import ModelConfig
from demandlab.functions import week_ending
from demandlab.plans.facts import business_filter

DATES = st.lists(st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2035, 12, 31)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(DATES)
def test_week_ending_rules_properties(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select("d", week_ending("d", "next").alias("n"), week_ending("d", "same_or_next").alias("s"),
                     week_ending("d", "monday_week").alias("m")).collect()
    for r in rows:
        assert r.n.weekday() == 5 and 1 <= (r.n - r.d).days <= 7
        assert r.s.weekday() == 5 and 0 <= (r.s - r.d).days <= 6
        assert r.m == r.d - dt.timedelta(days=r.d.weekday()) + dt.timedelta(days=5)


def test_business_filter_null_semantics(spark):
    cfg = ModelConfig()
    wk = dt.date(1998, 2, 7)
    rows = [(wk, "AMERICA", None, "b", "p", 1.0, 1.0),     # NULL category
            (wk, "AMERICA", "PROMO", "b", "p", 1.0, 1.0),  # excluded category
            (wk, "AMERICA", "SMALL", "b", "p", 0.0, 1.0),  # zero qty: POS drops, shipments keep
            (wk, "AMERICA", "SMALL", "b", None, 1.0, 1.0)]  # NULL product group
    df = spark.createDataFrame(rows, "week_ending_date date, business string, category string, brand string, "
                                     "ppg string, qty double, dollars double")
    sql = business_filter(df, cfg, excluded_categories=["PROMO"]).collect()
    pandas_like = business_filter(df, cfg, excluded_categories=["PROMO"], keep_null=True).collect()
    ship = business_filter(df, cfg, shipments=True, excluded_categories=["PROMO"]).collect()
    assert sql == []
    assert [(r.category, r.qty) for r in pandas_like] == [(None, 1.0)]
    assert [(r.category, r.qty) for r in ship] == [("SMALL", 0.0)]
