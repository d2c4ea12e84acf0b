"""Closed-form milestone decay vs a step-by-step version of the weekly
recurrence (written from the operator rules), plus per-series statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandlab.plans.external import with_policy_exposure
from demandlab.plans.forecast import pos_decay, ship_decay
from demandlab.plans.series import peak_statistics
from demandlab.config import ModelConfig


def mult(g):
    if g is None:
        return 0.05
    p = g * 100
    if g < 0:
        return 0.8
    if 0 <= p <= 50:
        return 0.2
    if 50 < p <= 100:
        return 0.15
    if 100 < p <= 500:
        return 0.1
    if 500 < p <= 1000:
        return 0.08
    return 0.05


def pos_steps(L, N, w, g, q, med, neg):
    f, qty = [0.0] * N, [0.0] * N
    f[L], qty[L] = g, q
    m2, m3 = L + w, L + w + 2
    if w <= 2:
        for i in range(L + 1, N):
            f[i] = med
    elif w == 3:
        for i in range(L, m3):
            f[i + 1] = f[i] * 0.5
        for i in range(m3, N):
            f[i] = med
    else:
        for i in range(L, m2):
            f[i + 1] = f[i] * 0.9
            qty[i + 1] = qty[i] * 0.9 if neg == 0 else qty[i] / 0.9
        qty[m2] = qty[m2 + 1] = 0.0
        for i in range(m2, m3):
            f[i + 1] = f[i] * 0.5
        for i in range(m3, N):
            f[i] = med
    return f, qty


def ship_steps(L, N, m1, m2, peak, g, q, med, neg):
    f, qty = [0.0] * N, [0.0] * N
    f[L], qty[L] = g, q
    first = L + m1
    second = first + 3 if L + m2 <= first else L + m2
    a = first + 1
    f[a] = mult(peak) * peak
    qty[a] = 0.9 * q if neg == 0 else q / 0.9
    b = second + 1
    for i in range(a, b):
        f[i + 1] = f[i] * 0.9
        qty[i + 1] = qty[i] * 0.9 if neg == 0 else qty[i] / 0.9
    c = b + 2
    qty[b] = qty[b + 1] = 0.0
    for i in range(b, c):
        f[i + 1] = f[i] * 0.5
    for i in range(c, N):
        f[i] = med
    return f, qty


@pytest.mark.parametrize("neg", [0, 1])
def test_pos_closed_form_matches_recurrence(spark, neg):
    L, N, g, q, med = 16, 32, 2.0, 100.0, 0.1
    rows = [(w, k) for w in [1, 2, 3, 4, 5, 6, 7, 8] for k in range(-L, N - L)]
    df = spark.createDataFrame(rows, "w int, k int")
    f, qty = pos_decay(F.col("k"), F.col("w"), F.lit(g), F.lit(q), F.lit(med), F.lit(neg))
    got = {(r.w, r.k): (r.f, r.q) for r in df.select("w", "k", f.alias("f"), qty.alias("q")).collect()}
    for w in [1, 2, 3, 4, 5, 6, 7, 8]:
        ef, eq = pos_steps(L, N, w, g, q, med, neg)
        for i in range(N):
            gf, gq = got[(w, i - L)]
            assert gf == pytest.approx(ef[i]), (w, i)
            assert gq == pytest.approx(eq[i]), (w, i)


@pytest.mark.parametrize("neg,peak", [(0, 0.75), (1, -0.3)])
def test_ship_closed_form_matches_recurrence(spark, neg, peak):
    L, N, g, q, med = 16, 34, 1.5, 80.0, -0.05
    cases = [(m1, m2) for m1 in (0, 1, 2) for m2 in range(-1, 8)]
    rows = [(m1, m2, k) for m1, m2 in cases for k in range(-L, N - L)]
    df = spark.createDataFrame(rows, "m1 int, m2 int, k int")
    f, qty = ship_decay(F.col("k"), F.col("m1"), F.col("m2"), F.lit(peak), F.lit(g), F.lit(q), F.lit(med), F.lit(neg))
    got = {(r.m1, r.m2, r.k): (r.f, r.q) for r in df.select("m1", "m2", "k", f.alias("f"), qty.alias("q")).collect()}
    for m1, m2 in cases:
        ef, eq = ship_steps(L, N, m1, m2, peak, g, q, med, neg)
        for i in range(N):
            gf, gq = got[(m1, m2, i - L)]
            assert gf == pytest.approx(ef[i]), (m1, m2, i)
            assert gq == pytest.approx(eq[i]), (m1, m2, i)


def test_policy_exposure_rules(spark):
    start, end, as_of = dt.date(2020, 4, 4), dt.date(2020, 4, 30), dt.date(2020, 5, 10)
    dates = [dt.date(2020, 4, 3), start, dt.date(2020, 4, 5), end, dt.date(2020, 5, 1), dt.date(2020, 5, 11)]
    rows = [(i, d, start, end) for i, d in enumerate(dates)] + [(99, start, None, end)]
    df = spark.createDataFrame(rows, "i int, date date, p_start_date date, p_end_date date")
    # a later end so the after-as_of case is not already zeroed by the end rule
    df = df.withColumn("p_end_date", F.when(F.col("i") == 5, F.lit(dt.date(2020, 6, 1))).otherwise(F.col("p_end_date")))
    out = with_policy_exposure(df, ["p"], as_of).orderBy("i").collect()
    assert [r.days_on_p for r in out] == [0, 0, 1, 26, 0, 0, None]
    assert [r.on_p for r in out] == [0, 0, 1, 1, 0, 0, 0]


def test_policy_duration_golden_row(spark):
    # stay-home 2020-04-04..2020-04-30 -> 26, business 2020-03-19..2020-06-15 -> 88,
    # no dates / no end -> NULL
    df = spark.createDataFrame([(dt.date(2020, 4, 4), dt.date(2020, 4, 30)), (dt.date(2020, 3, 19), dt.date(2020, 6, 15)),
                                (None, None), (dt.date(2020, 3, 1), None)], "s date, e date")
    assert [r.d for r in df.select(F.datediff("e", "s").alias("d")).collect()] == [26, 88, None, None]


def test_peak_tie_earliest_week_wins(spark):
    cfg = ModelConfig()
    rows = [("a", dt.date(1998, 3, 14), 11, 0.5, 10.0, 15.0), ("a", dt.date(1998, 3, 21), 12, 0.5, 20.0, 30.0),
            ("a", dt.date(1998, 1, 10), 2, 0.1, 10.0, 11.0), ("a", dt.date(1998, 1, 17), 3, 0.3, 10.0, 13.0),
            ("a", dt.date(1998, 4, 18), 16, -0.2, 10.0, 8.0)]
    y = spark.createDataFrame(rows, "sell_id string, week_ending_date date, week_of_year int, growth_qty double, "
                                    "qty_ly double, qty_ty double")
    r = peak_statistics(y, cfg).first()
    assert r.peak_max_growth == 0.5 and r.max_qty_ly == 10.0 and r.negative_impact == 0
    assert r.median_baseline == pytest.approx(0.2) and r.latest_growth == -0.2 and r.latest_qty == 8.0


def test_yoy_growth_zero_and_missing_last_year(spark):
    from demandlab.plans.series import _yoy
    cfg = ModelConfig()
    rows = [(dt.date(1998, 1, 10), "S", "C", 10.0, 5.0, 2, 1998, "C_S"),
            (dt.date(1997, 1, 11), "S", "C", 0.0, 0.0, 2, 1997, "C_S"),      # LY zero
            (dt.date(1998, 1, 17), "S", "C", 12.0, 6.0, 3, 1998, "C_S")]     # LY missing
    w = spark.createDataFrame(rows, "week_ending_date date, state string, category string, qty double, "
                                    "dollars double, week_of_year int, year int, sell_id string")
    out = {r.week_of_year: r for r in _yoy(w, cfg).collect()}
    assert out[2].qty_ly == 0.0 and out[2].growth_qty is None
    assert out[3].qty_ly is None and out[3].growth_qty is None and out[3].qty_ty == 12.0


def test_full_outer_yoy_matches_null_keys_through_sentinel(spark):
    from demandlab.plans.series import year_shift_full_outer
    rows = [(dt.date(1998, 1, 10), None, 10.0, 1.0, 2, 1998), (dt.date(1997, 1, 11), None, 4.0, 0.5, 2, 1997),
            (dt.date(1997, 1, 18), "k", 3.0, 0.3, 3, 1997)]
    w = spark.createDataFrame(rows, "week_ending_date date, key string, qty double, dollars double, "
                                    "week_of_year int, year int")
    out = year_shift_full_outer(w, ["key"]).collect()
    matched = [r for r in out if r.key == "Null_Value" and r.year == 1997 and r.week_of_year == 2]
    assert len(matched) == 1 and matched[0].qty == 10.0 and matched[0].stly_qty == 4.0
    assert any(r.key == "k" and r.qty is None and r.stly_qty == 3.0 for r in out)
