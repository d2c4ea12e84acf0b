"""Forecast models as set-based Spark plans.

The reference loops over product groups in Python (naive rate of sale,
centered last-year mean, milestone decay, a per-series seasonal fit, then
row-wise ``apply`` corrections).  Here every model is one plan over all
series at once:

* series x calendar grids (``operators.grid``) replace per-group merges;
* per-series scalars (latest growth/qty, peak growth, baselines, fitted
  trend) are single hash aggregations joined back on ``sell_id``;
* the week-by-week decay recurrences are replaced by their closed forms in
  ``k`` = weeks since the latest actual week (``x0 * r^k``), so no loop and
  no UDF is needed;
* row-wise corrections are ``when`` ladders evaluated in codegen.

Per-state milestone dates come from a parameter table with one row per state
(bounded by construction) and are broadcast.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import week_ending
from demandlab.functions.scalar import decay_multiplier, growth
from demandlab.operators.grid import series_grid
from demandlab.operators.least_squares import fit_groups
from demandlab.operators.windows import centered_count, centered_mean, fill_both, forward_fill, rolling_expr
from demandlab.plans.external import forecast_calendar
from demandlab.plans.milestones import projection_milestones
from demandlab.plans.series import (last_year, ly_rolling_median, model_weekly, peak_statistics,
                                    series_with_status)
from demandlab.session import shared
from demandlab.sources.literals import iso_week_saturday
from demandlab.sources.tables import Tables


def _grid_bounds(cfg: ModelConfig):
    """Saturday bounds that enclose every calendar week of the TY horizon
    (the calendar join keeps only real calendar weeks)."""
    jan1 = _dt.date(cfg.ty_year, 1, 1)
    start = jan1 + _dt.timedelta(days=(5 - jan1.weekday()) % 7) - _dt.timedelta(days=7)
    end = iso_week_saturday(cfg.ty_year, cfg.horizon_week) + _dt.timedelta(days=7)
    return start, end


def weeks_since(week: Column, anchor: _dt.date) -> Column:
    return F.floor(F.datediff(week, F.lit(anchor)) / F.lit(7)).cast("int")


def _k(cfg: ModelConfig) -> Column:
    return weeks_since(F.col("week_ending_date"), cfg.latest_week)


# ------------------------------------------------------------------ grids ----

def weekly_grid(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Every TY series x every calendar week; actual weeks up to L that had
    no sales are zero-filled, later weeks stay NULL."""
    w = model_weekly(t, cfg)
    ty = w.filter(F.col("year") == cfg.ty_year)
    keys = ty.groupBy("sell_id", "state", "category").agg(F.count(F.lit(1)).alias("n_actual_weeks"))
    cal = forecast_calendar(t, cfg).select("week_ending_date", "week_of_year")
    start, end = _grid_bounds(cfg)
    g = series_grid(keys, cal, start, end).join(
        ty.select("sell_id", "week_ending_date", "qty", "dollars"), ["sell_id", "week_ending_date"], "left")
    le = F.col("week_ending_date") <= F.lit(cfg.latest_week)
    return g.select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year",
        F.col("n_actual_weeks").cast("long").alias("n_actual_weeks"),
        F.when(le, F.coalesce("qty", F.lit(0.0))).otherwise(F.col("qty")).alias("qty_ty"),
        F.when(le, F.coalesce("dollars", F.lit(0.0))).otherwise(F.col("dollars")).alias("dollars_ty"),
    )


def fill_attributes(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Grid of the incomplete series where the descriptive columns come from
    the sparse fact rows and are filled forward, then backward, per series."""
    y, _, st = series_with_status(t, cfg, ["incomplete", "missing"])
    cal = forecast_calendar(t, cfg).select("week_ending_date", "week_of_year")
    start, end = _grid_bounds(cfg)
    g = series_grid(st.select("sell_id"), cal, start, end).join(
        y.select("sell_id", "week_ending_date", "state", "category", "qty_ty"),
        ["sell_id", "week_ending_date"], "left")
    part, order = ["sell_id"], "week_ending_date"
    return g.select(
        "sell_id", "week_ending_date", "week_of_year", "qty_ty",
        fill_both("state", part, order).alias("state"),
        fill_both("category", part, order).alias("category"),
        forward_fill("qty_ty", part, order).alias("qty_ty_ffill"),
    )


# ------------------------------------------------------------------ naive ----

def naive_rate_of_sale(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """POS naive model for series with insufficient history.

    week = L: actual; week > L: mean weekly quantity over the actual weeks
    (zero-filled) or, for a blank state, last year's quantity; earlier: NULL.
    A model output stage: materialized once.
    """
    return shared(t, ("naive_pos", cfg), lambda: _naive_pos(t, cfg))


def _naive_pos(t: Tables, cfg: ModelConfig) -> DataFrame:
    w = model_weekly(t, cfg)
    y, _, st = series_with_status(t, cfg, ["incomplete", "missing"])
    keys = st.filter(F.col("state").isNotNull()).select("sell_id", "state", "category")
    cal = forecast_calendar(t, cfg).select("week_ending_date", "week_of_year")
    start, end = _grid_bounds(cfg)
    g = series_grid(keys, cal, start, end).join(
        y.select("sell_id", "week_ending_date", "qty_ty", "dollars_ty"), ["sell_id", "week_ending_date"], "left")
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    le = wk <= L
    g = g.withColumns({
        "qty_ty": F.when(le, F.coalesce("qty_ty", F.lit(0.0))).otherwise(F.col("qty_ty")),
        "dollars_ty": F.when(le, F.coalesce("dollars_ty", F.lit(0.0))).otherwise(F.col("dollars_ty")),
    })
    g = g.withColumn("pos_actuals_avg", F.avg(F.when(le, F.col("qty_ty"))).over(Window.partitionBy("sell_id")))
    ly = last_year(w, cfg).select("sell_id", "week_of_year", F.col("qty").alias("qty_ly"),
                                  F.col("dollars").alias("dollars_ly"))
    g = g.join(ly, ["sell_id", "week_of_year"], "left")
    fq = (F.when(wk == L, F.col("qty_ty"))
          .when((wk > L) & (F.col("state") != ""), F.col("pos_actuals_avg"))
          .when((wk > L) & (F.col("state") == ""), F.col("qty_ly")))
    return g.select("sell_id", "state", "category", "week_ending_date", "week_of_year",
                    "qty_ty", "dollars_ty", "qty_ly", "dollars_ly", "pos_actuals_avg",
                    fq.alias("forecast_quantity"))


def naive_centered_mean(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Shipment naive model: centered 7-week mean of last year's quantity.

    Grid = actual TY weeks (zero-filled) + calendar weeks after L.  The first
    TY week is left out of the rolling window (its value is NULL), as in the
    reference.  Also carries the pre-event median YoY difference per series.
    A model output stage: materialized once.
    """
    return shared(t, ("naive_ship", cfg), lambda: _naive_ship(t, cfg))


def _naive_ship(t: Tables, cfg: ModelConfig) -> DataFrame:
    w = model_weekly(t, cfg, shipments=True)
    y, _, st = series_with_status(t, cfg, ["incomplete", "missing"], shipments=True)
    ty_weeks = (w.filter(F.col("year") == cfg.ty_year).select("week_ending_date").distinct())
    future = forecast_calendar(t, cfg).filter(F.col("week_ending_date") > F.lit(cfg.latest_week)) \
        .select("week_ending_date")
    weeks = ty_weeks.unionByName(future).withColumn("week_of_year", F.weekofyear("week_ending_date"))
    start, end = _grid_bounds(cfg)
    keys = st.select("sell_id", "state", "category")
    g = series_grid(keys, weeks, start, end).join(
        y.select("sell_id", "week_ending_date", "qty_ty", "dollars_ty"), ["sell_id", "week_ending_date"], "left")
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    le = wk <= L
    ly = last_year(w, cfg).select("sell_id", "week_of_year", F.col("qty").alias("qty_ly"))
    g = (g.withColumns({
            "qty_ty": F.when(le, F.coalesce("qty_ty", F.lit(0.0))).otherwise(F.col("qty_ty")),
            "dollars_ty": F.when(le, F.coalesce("dollars_ty", F.lit(0.0))).otherwise(F.col("dollars_ty")),
         })
         .join(ly, ["sell_id", "week_of_year"], "left")
         .withColumn("qty_ly", F.coalesce("qty_ly", F.lit(0.0))))
    first_week = iso_week_saturday(cfg.ty_year, 1)
    excl = wk == F.lit(first_week)
    g = g.withColumn("excluded", excl)
    roll = F.when(~F.col("excluded"), centered_mean("qty_ly", ["sell_id", "excluded"], "week_ending_date", 7))
    pre = y.filter(F.col("week_ending_date") < F.lit(cfg.pre_event_to)).groupBy("sell_id").agg(
        F.percentile(growth("qty_ty", "qty_ly"), F.lit(0.5)).alias("med_qty_diff"))
    g = g.withColumn("qty_ly_centered7_mean", roll).join(pre, "sell_id", "left")
    fq = (F.when(wk == L, F.col("qty_ty"))
          .when(wk < L, F.lit(None).cast("double"))
          .otherwise(F.coalesce("qty_ly_centered7_mean", F.lit(0.0))))
    return g.select("sell_id", "state", "category", "week_ending_date", "week_of_year", "qty_ty", "dollars_ty",
                    "qty_ly", "qty_ly_centered7_mean",
                    F.coalesce("med_qty_diff", F.lit(0.0)).alias("med_qty_diff"),
                    fq.alias("forecast_quantity"), F.lit(0).alias("common_product"))


# ------------------------------------------------------------- milestones ----

def state_milestones(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per state: national peak week, 30 % week, and the POS / shipment
    second and third milestones with the POS forecast type, from the projection
    series (m:1).  A state without projections fails the job: its series would
    get no forecast."""
    reg = t.region.select(F.col("r_name").alias("state"))
    m = reg.join(F.broadcast(projection_milestones(t, cfg)), "state", "left")  # a row per state
    gone = F.raise_error(F.concat(F.lit("no projection for state "), F.coalesce("state", F.lit("NULL")))).cast("date")
    peak = week_ending(F.coalesce("national_peak_day", gone), "same_or_next")
    thirty = week_ending("fall_day", "same_or_next")
    L = F.lit(cfg.latest_week)
    m = m.select("state", peak.alias("first_milestone_date"), thirty.alias("thirty_pct_week"))
    raw_w = F.datediff("thirty_pct_week", L) / 7.0
    pos_second = F.when(raw_w >= 6, F.date_sub("thirty_pct_week", 28)).otherwise(F.col("thirty_pct_week"))
    m = m.withColumn("pos_second_milestone_date", pos_second)
    pos_w = F.datediff("pos_second_milestone_date", L) / 7.0
    ship_second = F.when(F.col("thirty_pct_week") <= F.col("first_milestone_date"),
                         F.date_add("first_milestone_date", 21)).otherwise(F.col("thirty_pct_week"))
    return m.select(
        "state", "first_milestone_date", "thirty_pct_week", "pos_second_milestone_date",
        F.date_add("pos_second_milestone_date", 14).alias("pos_third_milestone_date"),
        pos_w.cast("int").alias("pos_weeks_to_second"),
        F.when(pos_w <= 2, 1).when(pos_w == 3, 2).when(pos_w > 3, 3).alias("fc_type"),
        ship_second.alias("ship_second_milestone_date"),
        F.date_add(ship_second, 14).alias("ship_third_milestone_date"),
    )


def milestone_markers(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """One marker row per state and milestone (stacked, not three unions)."""
    m = state_milestones(t, cfg)
    return m.selectExpr(
        "state",
        "stack(3, 'first', first_milestone_date, 'second', pos_second_milestone_date, "
        "'third', pos_third_milestone_date) as (marker, marker_date)",
    ).withColumn("week_of_year", F.weekofyear("marker_date"))


def _milestone_base(t: Tables, cfg: ModelConfig, shipments: bool):
    w = model_weekly(t, cfg, shipments=shipments)
    y, _, st = series_with_status(t, cfg, ["complete"], shipments=shipments)
    stats = peak_statistics(y, cfg)
    ms = state_milestones(t, cfg)
    keys = st.filter(F.col("state").isNotNull()).select("sell_id", "state", "category")
    cal = forecast_calendar(t, cfg).select("week_ending_date", "week_of_year")
    start, end = _grid_bounds(cfg)
    g = (series_grid(keys, cal, start, end)
         .join(y.select("sell_id", "week_ending_date", "qty_ty", "dollars_ty", "growth_qty", "growth_sales"),
               ["sell_id", "week_ending_date"], "left")
         .join(stats, "sell_id", "inner")
         .join(F.broadcast(ms), "state", "inner")
         .withColumn("k", _k(cfg)))
    return g, w, y, stats


def pos_decay(k: Column, w: Column, g: Column, q: Column, med: Column, neg: Column):
    """Closed form of the POS milestone recurrence -> (forecast1, quantity).

    k = weeks since L, w = weeks from L to the (shifted) second milestone,
    g / q = growth / quantity at L, med = pre-event median growth,
    neg = 1 for a negative peak impact.
    """
    f = (F.when(k < 0, F.lit(0.0)).when(k == 0, g)
         .when(w <= 2, med)
         .when(w == 3, F.when(k >= 5, med).otherwise(g * F.pow(F.lit(0.5), k)))
         .otherwise(F.when(k >= w + 2, med)
                    .when(k <= w, g * F.pow(F.lit(0.9), k))
                    .otherwise(g * F.pow(F.lit(0.9), w) * F.pow(F.lit(0.5), k - w))))
    qty = (F.when(k < 0, F.lit(0.0)).when(k == 0, q)
           .when((w > 3) & (k < w),
                 F.when(neg == 0, q * F.pow(F.lit(0.9), k)).otherwise(q / F.pow(F.lit(0.9), k)))
           .otherwise(F.lit(0.0)))
    return f, qty


def ship_decay(k: Column, m1: Column, m2: Column, peak: Column, g: Column, q: Column, med: Column, neg: Column):
    """Closed form of the shipment milestone recurrence -> (forecast1, quantity).

    m1 / m2 = weeks from L to the national peak and to the state's 30 % week.
    A = m1 + 1 (first milestone shifted a week), B = second milestone (m2, or
    m1 + 3 when the 30 % week is not after the peak) + 1, C = B + 2.
    """
    A = m1 + 1
    B = F.when(m2 > m1, m2).otherwise(m1 + 3) + 1
    C = B + 2
    start = decay_multiplier(peak) * peak
    f = (F.when(k < 0, F.lit(0.0)).when(k == 0, g).when(k < A, F.lit(0.0))
         .when(k >= C, med)
         .when(k <= B, start * F.pow(F.lit(0.9), k - A))
         .otherwise(start * F.pow(F.lit(0.9), B - A) * F.pow(F.lit(0.5), k - B)))
    e = k - A + 1
    qty = (F.when(k < 0, F.lit(0.0)).when(k == 0, q).when(k < A, F.lit(0.0))
           .when(k < B, F.when(neg == 0, q * F.pow(F.lit(0.9), e)).otherwise(q / F.pow(F.lit(0.9), e)))
           .otherwise(F.lit(0.0)))
    return f, qty


def milestone_forecast_pos(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """POS milestone decay (closed form of the reference's weekly recurrence).

    w = weeks from L to the (shifted) second milestone; g, q = growth and
    quantity at L; med = pre-event median growth.
      w <= 2  (type 1): forecast1 = med after L
      w == 3  (type 2): g * 0.5^k until the third milestone (k = 5), then med
      w > 3   (type 3): g * 0.9^k through the second milestone, then halving
                        for one week, med from the third milestone; quantity
                        decays (or grows for a negative impact) by 0.9 a week
                        before the second milestone and is 0 afterwards.
    """
    return _milestone_pos(t, cfg).drop("max_qty_ly")


def _milestone_pos(t: Tables, cfg: ModelConfig) -> DataFrame:
    """``milestone_forecast_pos`` with the peak weeks' largest last-year quantity."""
    g, _, _, _ = _milestone_base(t, cfg, shipments=False)
    f, qty = pos_decay(F.col("k"), F.col("pos_weeks_to_second"), F.col("latest_growth"), F.col("latest_qty"),
                       F.col("median_baseline"), F.col("negative_impact"))
    return g.select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year",
        "qty_ty", "dollars_ty", "growth_qty", "growth_sales",
        f.alias("forecast1"), qty.alias("forecast_quantity"), "fc_type",
        "first_milestone_date",
        F.col("pos_second_milestone_date").alias("second_milestone_date"),
        F.col("pos_third_milestone_date").alias("third_milestone_date"),
        "median_baseline", "negative_impact", "max_qty_ly",
    )


def milestone_forecast_ship(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Shipment milestone decay (closed form).

    A = weeks to the first milestone + 1 (shifted a week), B = weeks to the
    second milestone + 1 (state 30 % week, or peak + 3 weeks when that is not
    later than the peak), C = B + 2.  Weeks strictly between L and A: 0.
    forecast1 = mult(peak) * peak * 0.9^(k-A) through B, halves once, med
    from C.  Quantity = q * 0.9^(k-A+1) (or divided for a negative impact)
    before B, then 0.
    """
    g, _, _, _ = _milestone_base(t, cfg, shipments=True)
    L = F.lit(cfg.latest_week)
    m1 = F.floor(F.datediff("first_milestone_date", L) / 7).cast("int")
    m2 = F.floor(F.datediff("thirty_pct_week", L) / 7).cast("int")
    f, qty = ship_decay(F.col("k"), m1, m2, F.col("peak_max_growth"), F.col("latest_growth"), F.col("latest_qty"),
                        F.col("median_baseline"), F.col("negative_impact"))
    return g.select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year",
        "qty_ty", "dollars_ty", "growth_qty", "growth_sales",
        f.alias("forecast1"), qty.alias("forecast_quantity"),
        "first_milestone_date",
        F.col("ship_second_milestone_date").alias("second_milestone_date"),
        F.date_add("ship_second_milestone_date", 21).alias("third_milestone_date"),
        "median_baseline", "negative_impact", "peak_max_growth", "max_qty_ly",
    )


# --------------------------------------------------------------- seasonal ----

def trend_seasonal_model(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, weekly: DataFrame | None = None,
                         shipments: bool = False) -> DataFrame:
    """Per-series linear trend + week-of-year seasonal index, clamped to the
    [floor, cap] of the training target up to ``cap_floor_until``.

    Fit = one aggregation (``regr_slope`` / ``regr_intercept``); seasonal
    index = mean residual per ISO week; forecast rows for the 24 weeks after L
    come from ``sequence`` + ``explode`` per series.  A model output stage:
    materialized once (it feeds the baseline choice and the growth flag).
    """
    if weekly is not None:
        return _trend_seasonal(weekly, cfg)
    return shared(t, ("trend_seasonal", cfg, shipments),
                  lambda: _trend_seasonal(model_weekly(t, cfg, shipments=shipments), cfg))


def _trend_seasonal(w: DataFrame, cfg: ModelConfig) -> DataFrame:
    origin = iso_week_saturday(cfg.ly_year, 1)
    w = w.withColumn("t_idx", weeks_since(F.col("week_ending_date"), origin).cast("double"))
    until = F.col("week_ending_date") <= F.lit(cfg.cap_floor_until)
    fit = w.groupBy("sell_id").agg(
        F.regr_slope("qty", "t_idx").alias("slope"),
        F.regr_intercept("qty", "t_idx").alias("intercept"),
        F.min(F.when(until, F.col("qty"))).alias("floor"),
        F.max(F.when(until, F.col("qty"))).alias("cap"),
    )
    season = (w.join(fit, "sell_id")
               .withColumn("resid", F.col("qty") - (F.col("intercept") + F.col("slope") * F.col("t_idx")))
               .groupBy("sell_id", "week_of_year").agg(F.avg("resid").alias("season")))
    first = cfg.latest_week + _dt.timedelta(days=7)
    last = cfg.latest_week + _dt.timedelta(days=7 * (cfg.seasonal_horizon_weeks - 1))
    fut = (fit.withColumn("week_ending_date",
                          F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 7 DAYS"))))
              .withColumns({"week_of_year": F.weekofyear("week_ending_date"),
                            "t_idx": weeks_since(F.col("week_ending_date"), origin).cast("double")}))
    fc = fut.join(season, ["sell_id", "week_of_year"], "left")
    yhat = F.col("intercept") + F.col("slope") * F.col("t_idx") + F.coalesce("season", F.lit(0.0))
    return fc.select("sell_id", "week_ending_date", "week_of_year",
                     F.least(F.greatest(yhat, F.col("floor")), F.col("cap")).alias("seasonal_forecast"))


def high_growth_flags(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, weekly: DataFrame | None = None,
                      seasonal: DataFrame | None = None) -> DataFrame:
    """Mean (forecast - LY) / LY from ``high_growth_from`` on; |mean| > 0.5."""
    w = weekly if weekly is not None else model_weekly(t, cfg)
    if seasonal is None:
        seasonal = trend_seasonal_model(t, cfg, w) if weekly is not None else trend_seasonal_model(t, cfg)
    s = seasonal
    ly = last_year(w, cfg).select("sell_id", "week_of_year", F.col("qty").alias("qty_ly"))
    d = (s.filter(F.col("week_ending_date") >= F.lit(cfg.high_growth_from))
          .join(ly, ["sell_id", "week_of_year"], "left")
          .groupBy("sell_id").agg(F.avg(growth("seasonal_forecast", "qty_ly")).alias("mean_pct_diff")))
    return d.withColumn("high_growth_decline", F.abs("mean_pct_diff") > cfg.high_growth_threshold)


def seasonal_rolling_median(seasonal: DataFrame, k: int = 6) -> DataFrame:
    return seasonal.withColumn(
        "seasonal_roll6_median", rolling_expr("seasonal_forecast", ["sell_id"], "week_ending_date", k, "median"))


# -------------------------------------------------------- post-processing ----

def _adjust(base: DataFrame, cfg: ModelConfig, *, shipments: bool) -> DataFrame:
    """Rules 4-7: growth clamp, forecast value, outlier update, promo uplift.

    ``base`` carries: week_ending_date, forecast1, forecast_quantity (decayed
    quantity), median_baseline, negative_impact, second/third milestone,
    qty_ty, qty_ly, roll (baseline), max_qty_ly, high_growth_decline.
    """
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    neg, med, f0 = F.col("negative_impact"), F.col("median_baseline"), F.col("forecast1")
    m2, m3 = F.col("second_milestone_date"), F.col("third_milestone_date")
    roll, hgd = F.col("roll"), F.col("high_growth_decline")
    f1 = F.when(wk > L, F.when(neg == 0, F.when(f0 < med, med).otherwise(f0))
                .otherwise(F.when(f0 > med, med).otherwise(f0))).otherwise(f0)
    base = base.withColumn("forecast1", f1)
    f = F.col("forecast1")
    pos_val = (F.when(wk == L, F.col("qty_ty"))
               .when((wk > L) & (wk < m2), F.col("forecast_quantity"))
               .when((wk >= m2) & (hgd == F.lit(True)), roll)
               .when(wk >= m2, (1 + f) * roll))
    neg_val = (F.when(wk == L, F.col("qty_ty"))
               .when((wk > L) & (wk < m2), F.col("forecast_quantity"))
               .when((wk >= m2) & (wk < m3), (1 + f) * F.col("max_qty_ly"))
               .when((wk >= m3) & (hgd == F.lit(True)), roll)
               .when(wk >= m3, (1 + f) * roll))
    base = base.withColumn("forecast_quantity", F.when(neg == 0, pos_val).otherwise(neg_val))
    base = base.withColumn("forecast_growth", growth("forecast_quantity", "qty_ly"))
    bound = m2 if shipments else m3
    upd = (wk > L) & (wk < bound) & ~F.coalesce(hgd, F.lit(False))
    fg, fq = F.col("forecast_growth"), F.col("forecast_quantity")
    new_fq = F.when(neg == 0, F.when(upd & (fg < f), (1 + f) * roll).otherwise(fq)) \
              .otherwise(F.when(upd & (fg > f), (1 + f) * roll).otherwise(fq))
    base = base.withColumn("forecast_quantity", new_fq)
    gap = F.col("qty_ly") - roll
    if shipments:
        promo = F.when(wk >= F.lit(cfg.ship_promo_from), F.when(gap > 0, gap).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    else:
        promo = F.when(wk >= m2, gap).otherwise(F.lit(0.0))
    base = base.withColumn("promo_uplift", promo)
    if not shipments:
        before = wk < L
        base = base.withColumns({c: F.when(~before, F.col(c)) for c in
                                 ["forecast1", "forecast_quantity", "forecast_growth", "promo_uplift"]})
    return base


def _adjusted(t: Tables, cfg: ModelConfig, shipments: bool) -> DataFrame:
    base = milestone_forecast_ship(t, cfg) if shipments else _milestone_pos(t, cfg)
    w = model_weekly(t, cfg, shipments=shipments)
    ly = last_year(w, cfg).select("sell_id", "week_of_year", F.col("qty").alias("qty_ly"),
                                  F.col("dollars").alias("dollars_ly"))
    lymed = ly_rolling_median(w, cfg, 6).select("sell_id", "week_of_year", "qty_ly_roll6_median")
    seasonal = trend_seasonal_model(t, cfg, shipments=shipments)
    hg = high_growth_flags(t, cfg, weekly=w, seasonal=seasonal).select("sell_id", "high_growth_decline")
    # The flag travels with the seasonal forecast rows (series x forecast
    # week), so actual weeks carry no flag -- it is only read after L.
    smed = (seasonal_rolling_median(seasonal).select("sell_id", "week_ending_date", "seasonal_roll6_median")
            .join(hg, "sell_id", "inner"))
    b = (base.join(ly, ["sell_id", "week_of_year"], "left")
             .join(lymed, ["sell_id", "week_of_year"], "left")
             .join(smed, ["sell_id", "week_ending_date"], "left")
             .withColumn("roll", F.coalesce("seasonal_roll6_median", "qty_ly_roll6_median")))
    out = _adjust(b, cfg, shipments=shipments)
    return out.select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year", "qty_ty", "qty_ly", "dollars_ly",
        F.col("roll").alias("qty_rolling_6_week_med"), "max_qty_ly", "forecast1", "forecast_quantity",
        "forecast_growth", "promo_uplift", "first_milestone_date", "second_milestone_date",
        "third_milestone_date", "median_baseline", "negative_impact", "high_growth_decline")


def forecast_adjusted(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """POS: milestone forecast + baseline choice + clamps + update + promo.
    A model output stage: materialized once and reused downstream."""
    return shared(t, ("forecast_adjusted", cfg),
                  lambda: _adjusted(t, cfg, shipments=False))


def ship_forecast_adjusted(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Shipments: same rules, update bounded by the second milestone, promo
    uplift from two weeks after the training end, floored at 0."""
    return shared(t, ("ship_forecast_adjusted", cfg),
                  lambda: _adjusted(t, cfg, shipments=True))


def ship_forecast_combined(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Common (milestone) + incomplete (naive) shipment series, with the
    state milestone table attached, promo dampening for incomplete series
    (1 - zero-LY weeks in a centered 7-week window / 7) and forecasts before
    the training end nulled.  Materialized once (the shipment model output)."""
    return shared(t, ("ship_forecast_combined", cfg),
                  lambda: _ship_combined(t, cfg))


def _ship_combined(t: Tables, cfg: ModelConfig) -> DataFrame:
    common = ship_forecast_adjusted(t, cfg).withColumn("common_product", F.lit(1))
    naive = naive_centered_mean(t, cfg).select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year", "qty_ty", "qty_ly",
        F.col("qty_ly_centered7_mean").alias("qty_rolling_6_week_med"), "forecast_quantity", "common_product")
    allr = common.unionByName(naive, allowMissingColumns=True)
    ms = state_milestones(t, cfg).select(
        "state", F.col("ship_third_milestone_date").alias("state_third_milestone_date"))
    allr = allr.join(F.broadcast(ms), "state", "left")
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    gap = F.col("qty_ly") - F.col("qty_rolling_6_week_med")
    allr = allr.withColumn(
        "promo_uplift",
        F.when(wk >= F.lit(cfg.ship_promo_from), F.when(gap > 0, gap).otherwise(F.lit(0.0))).otherwise(F.lit(0.0)))
    allr = allr.withColumn("forecast_quantity", F.when(wk >= L, F.col("forecast_quantity")))
    zeros = centered_count(F.col("qty_ly") == 0, ["sell_id"], "week_ending_date", 7)
    mult = F.when(F.col("common_product") == 1, F.lit(1.0)).otherwise(1 - zeros / 7.0)
    allr = allr.withColumn("dampen_multiplier", mult)
    return allr.withColumn("promo_uplift_new", F.col("promo_uplift") * F.col("dampen_multiplier"))


# ------------------------------------------------- grouped seasonal fit ----

HARMONICS = 3          # yearly Fourier terms of the fit
SEASONAL_RIDGE = 1.0   # ridge on the Fourier coefficients


def fourier_terms(day: Column, origin: _dt.date) -> list[Column]:
    """Constant, trend in years since ``origin``, and yearly sine and cosine terms."""
    angle = F.dayofyear(day) * F.lit(2 * math.pi / 365.25)
    return [F.lit(1.0), F.datediff(day, F.lit(origin)) / F.lit(364.0),
            *[f(F.lit(float(h)) * angle) for h in range(1, HARMONICS + 1) for f in (F.sin, F.cos)]]


def seasonal_fit_grouped(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """``fourier_forecast`` of the modelling series."""
    return fourier_forecast(model_weekly(t, cfg), cfg)


def fourier_forecast(weekly: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Trend and yearly Fourier terms per series by least squares, with a ridge
    on the Fourier coefficients; the forecast is clamped to the [floor, cap] of
    the training weeks up to ``cap_floor_until`` (not at all without any).

    Set-based: one aggregation of sums of products for all series, the normal
    equations are solved by expressions (``least_squares``), no Python.
    """
    origin = _dt.date(cfg.ly_year, 1, 1)
    w = weekly.select("sell_id", "week_ending_date", "qty")
    early = F.when(F.col("week_ending_date") <= F.lit(cfg.cap_floor_until), F.col("qty"))
    fit = fit_groups(w, ["sell_id"], fourier_terms(F.col("week_ending_date"), origin), "qty",
                     [0.0, 0.0] + [SEASONAL_RIDGE] * 2 * HARMONICS, {"floor": F.min(early), "cap": F.max(early)})
    weeks = F.explode(F.sequence(F.lit(1), F.lit(cfg.seasonal_horizon_weeks - 1)))
    out = fit.withColumn("__week", weeks).withColumn("week_ending_date", F.date_add(F.lit(cfg.latest_week), F.col("__week") * 7))
    terms = fourier_terms(F.col("week_ending_date"), origin)
    value = sum((F.col(f"beta{j}") * x for j, x in enumerate(terms)), F.lit(0.0))
    return out.select("sell_id", "week_ending_date", F.least(F.greatest(value, F.col("floor")), F.col("cap")).alias("seasonal_forecast"))
