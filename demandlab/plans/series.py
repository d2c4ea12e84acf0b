"""Model series: weekly sales at the modelling grain, YoY alignment,
lifespan split, peak statistics and last-year rolling baselines.

Modelling grain (declared in one place): ``state`` := region name,
``category`` := product type, ``sell_id`` := '<category>_<state>'.

Scale notes: every operator here runs on the weekly aggregate (series x
week), not on ledger lines; the aggregate is derived from the materialized
weekly fact and materialized itself.  Per-series statistics are single hash
aggregations (``max_by`` / ``percentile`` with conditional inputs) instead of
sort + row-number.  Windows are partitioned by ``sell_id``: one window
partition holds one series' weekly rows (at most one row per week of the
model span), so a series with huge sales is no larger than any other and no
hot window partition can form.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import week_ending
from demandlab.functions.scalar import composite_key, growth
from demandlab.operators.joins import attach_scalars
from demandlab.operators.windows import rolling
from demandlab.plans.facts import sales_fact, with_week_fields
from demandlab.session import shared
from demandlab.sources.tables import Tables

SERIES_KEYS = ["state", "category"]


def model_weekly(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False) -> DataFrame:
    """Filtered weekly sales at the modelling grain, TY and LY, up to L.

    Both variants (POS keeps strictly positive weeks, shipments keep zeros)
    are a filter over one materialized aggregate, which itself is derived
    from the materialized weekly fact -- no second ledger join.
    """
    base = shared(t, ("model_weekly_base", cfg),
                  lambda: build_model_weekly_base(t, cfg))
    return base.filter(variant_filter(shipments))


def variant_filter(shipments: bool):
    if shipments:
        keep = (F.col("qty") >= 0) & (F.col("dollars") >= 0)
    else:
        keep = (F.col("qty") > 0) & (F.col("dollars") > 0)
    return keep & ~(F.col("qty").isNull() & F.col("dollars").isNull())


def build_model_weekly_base(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Weekly fact -> (week, state := business, category) sums in the model
    window.  The row filters (blank / NULL product group, blank hierarchy,
    excluded categories) are on grouping keys of the weekly fact, so
    filtering its rows equals filtering ledger lines; the year filter prunes
    partitions of the year-partitioned weekly fact."""
    from demandlab.plans.facts import weekly_fact
    years = list(range(cfg.history_start.year, cfg.latest_week.year + 1))
    wf = weekly_fact(t, cfg).filter(F.col("year").isin(years))
    excluded = list(cfg.excluded_categories)
    row_ok = ~((F.col("ppg") == "") | F.col("ppg").isNull())
    row_ok = row_ok & ~((F.col("business") == "") & (F.col("category") == "")
                        & (F.col("brand") == "") & (F.col("ppg") != ""))
    if excluded:
        row_ok = row_ok & ~F.col("category").isin(excluded)
    wk = F.col("week_ending_date")
    in_window = (wk > F.lit(cfg.history_start)) & (wk <= F.lit(cfg.latest_week))
    weekly = (wf.filter(row_ok & in_window)
                .groupBy("week_ending_date", F.col("business").alias("state"), "category")
                .agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars")))
    out = with_week_fields(weekly)
    return out.withColumn("sell_id", composite_key("category", "state"))


def last_year(weekly: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    return weekly.filter(F.col("year") == cfg.ly_year)


def yoy_growth(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False,
               weekly: DataFrame | None = None) -> DataFrame:
    """TY weeks left-joined to LY on series keys + ISO week; NULL-safe keys.
    Materialized once per variant (every model reads it)."""
    if weekly is None:
        return shared(t, ("yoy", cfg, shipments),
                      lambda: _yoy(model_weekly(t, cfg, shipments=shipments), cfg))
    return _yoy(weekly, cfg)


def _yoy(w: DataFrame, cfg: ModelConfig) -> DataFrame:
    ty = w.filter(F.col("year") == cfg.ty_year)
    ly = last_year(w, cfg).select(
        F.col("state").alias("ly_state"), F.col("category").alias("ly_category"),
        F.col("week_of_year").alias("ly_week"),
        F.col("qty").alias("qty_ly"), F.col("dollars").alias("dollars_ly"))
    cond = (ty.state.eqNullSafe(ly.ly_state) & ty.category.eqNullSafe(ly.ly_category)
            & (ty.week_of_year == ly.ly_week))
    j = ty.join(ly, cond, "left")
    return j.select(
        "sell_id", "state", "category", "week_ending_date", "week_of_year",
        F.col("qty").alias("qty_ty"), F.col("dollars").alias("dollars_ty"),
        "qty_ly", "dollars_ly",
        growth("qty", "qty_ly").alias("growth_qty"),
        growth("dollars", "dollars_ly").alias("growth_sales"),
    )


def yoy_full_outer(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, null_sentinel: str = "Null_Value") -> DataFrame:
    """All years: each (year, ISO week, keys) row next to the same week a
    year earlier, full outer, with NULL keys matched through a sentinel."""
    from demandlab.plans.facts import weekly_sales  # local: avoid cycle at import

    keys = ["retailer", "state", "business", "category", "brand", "ppg", "channel"]
    return year_shift_full_outer(weekly_sales(t, cfg, with_channel=True), keys, null_sentinel)


def year_shift_full_outer(w: DataFrame, keys, null_sentinel: str = "Null_Value") -> DataFrame:
    """Rows keyed by (ISO year - 1, ISO week) next to the rows of that ISO year:
    same-time-last-year measures, full outer.  The ISO year is the year of the
    week's Thursday, so (year, week) names one week and no row meets two.
    NULL string keys are replaced by ``null_sentinel`` so they match each other
    (kept in the output).

    Both roles of a row are stacked and grouped by the key: one shuffle, no
    join (``w`` has one row per week and keys).
    """
    w = w.na.fill(null_sentinel, subset=list(keys)).withColumn("year", F.year(F.date_sub("week_ending_date", 2)))
    curr = w.select((F.col("year") - 1).alias("year"), "week_of_year", *keys, "week_ending_date", "qty", "dollars")
    prev = w.select("year", "week_of_year", *keys, F.col("qty").alias("stly_qty"), F.col("dollars").alias("stly_dollars"))
    values = ["week_ending_date", "qty", "dollars", "stly_qty", "stly_dollars"]
    return curr.unionByName(prev, allowMissingColumns=True).groupBy("year", "week_of_year", *keys) \
        .agg(*[F.max(c).alias(c) for c in values])


def yoy_category(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, null_sentinel: str = "Null_Value") -> DataFrame:
    """``yoy_full_outer`` at the (state, business, category) grain, where weeks of
    neighbouring years meet; lines of one category (SMALL) come without its name."""
    from demandlab.plans.facts import weekly_sales
    w = weekly_sales(t, cfg, with_channel=True)
    cat = F.when(F.col("category") != "SMALL", F.col("category"))
    w = w.groupBy("week_ending_date", "week_of_year", "state", "business", cat.alias("category")) \
        .agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars"))
    return year_shift_full_outer(w, ["state", "business", "category"], null_sentinel)


def lifespan_split(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False,
                   weekly: DataFrame | None = None) -> DataFrame:
    """complete / incomplete / missing per TY series.

    POS: TY-complete = as many weeks as the highest ISO week seen; LY-complete
    = 52 weeks.  Shipments: TY-complete = number of distinct TY weeks; LY
    complete = all ISO weeks <= 32.  Materialized once per variant.
    """
    if weekly is None:
        return shared(t, ("lifespan", cfg, shipments),
                      lambda: _lifespan(model_weekly(t, cfg, shipments=shipments), cfg, shipments))
    return _lifespan(weekly, cfg, shipments)


def _lifespan(w: DataFrame, cfg: ModelConfig, shipments: bool) -> DataFrame:
    ty = w.filter(F.col("year") == cfg.ty_year)
    # Weekly rows are unique per (series, week) by construction (they are the
    # group-by keys of the weekly aggregate), so a plain count is the number
    # of distinct weeks -- no distinct-aggregation shuffle.
    per_ty = ty.groupBy("sell_id", "state", "category").agg(
        F.count("week_ending_date").alias("weeks_ty"))
    if shipments:
        target = ty.select("week_ending_date").distinct().agg(F.count(F.lit(1)).alias("target_weeks"))
        ly = last_year(w, cfg).filter(F.col("week_of_year") <= cfg.ship_ly_weeks)
        ly_target = cfg.ship_ly_weeks
    else:
        target = ty.agg(F.max("week_of_year").alias("target_weeks"))
        ly = last_year(w, cfg)
        ly_target = cfg.ly_full_weeks
    per_ly = ly.groupBy("sell_id").agg(F.count("week_ending_date").alias("weeks_ly"))
    s = attach_scalars(per_ty, target).join(per_ly, "sell_id", "left")
    complete_ty = F.col("weeks_ty") == F.col("target_weeks")
    complete_ly = F.coalesce(F.col("weeks_ly") == ly_target, F.lit(False))
    status = (F.when(complete_ty & complete_ly, "complete")
              .when(F.col("weeks_ty") < F.col("target_weeks"), "incomplete")
              .otherwise("missing"))
    return s.select("sell_id", "state", "category",
                    F.col("weeks_ty").cast("long").alias("weeks_ty"),
                    F.coalesce(F.col("weeks_ly"), F.lit(0)).cast("long").alias("weeks_ly"),
                    status.alias("status"))


def series_coverage(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False) -> DataFrame:
    """Share of series / quantity / revenue per lifespan status."""
    w = model_weekly(t, cfg, shipments=shipments)
    status = lifespan_split(t, cfg, shipments=shipments)
    ty_tot = (w.filter(F.col("year") == cfg.ty_year)
               .groupBy("sell_id").agg(F.sum("qty").alias("qty"), F.sum("dollars").alias("dollars")))
    per = (status.join(ty_tot, "sell_id", "left")
                 .groupBy("status")
                 .agg(F.count(F.lit(1)).alias("n_series"), F.sum("qty").alias("qty_ty"),
                      F.sum("dollars").alias("dollars_ty")))
    # <= 3 rows: a global window here is free.
    allw = Window.partitionBy()
    return per.select(
        "status", F.col("n_series").cast("long").alias("n_series"),
        F.round("qty_ty", 4).alias("qty_ty"), F.round("dollars_ty", 4).alias("dollars_ty"),
        F.round(100.0 * F.col("n_series") / F.sum("n_series").over(allw), 4).alias("pct_series"),
        F.round(100.0 * F.col("qty_ty") / F.sum("qty_ty").over(allw), 4).alias("pct_qty"),
    )


def series_with_status(t: Tables, cfg: ModelConfig, statuses, *, shipments: bool = False,
                       weekly: DataFrame | None = None):
    """(yoy rows of the chosen lifespan statuses, weekly, status table)."""
    if weekly is None:
        w = model_weekly(t, cfg, shipments=shipments)
        y = yoy_growth(t, cfg, shipments=shipments)
        st = lifespan_split(t, cfg, shipments=shipments)
    else:
        w, y, st = weekly, yoy_growth(t, cfg, weekly=weekly), lifespan_split(t, cfg, shipments=shipments, weekly=weekly)
    st = st.filter(F.col("status").isin(list(statuses)))
    return y.join(st.select("sell_id"), "sell_id", "left_semi"), w, st


def peak_statistics(yoy: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per series: peak growth in the peak weeks (earliest week wins a tie),
    last year's quantity at that week, impact sign, pre-event median/mean
    growth, and the growth/quantity at the latest week.  One aggregation."""
    woy = F.col("week_of_year")
    in_peak = woy.between(cfg.peak_week_from, cfg.peak_week_to) & F.col("growth_qty").isNotNull()
    order = F.when(in_peak, F.struct(F.col("growth_qty"), (-woy).alias("neg_week")))
    pre = (F.col("week_ending_date") >= F.lit(cfg.pre_event_from)) & (F.col("week_ending_date") < F.lit(cfg.pre_event_to))
    at_l = F.col("week_ending_date") == F.lit(cfg.latest_week)
    agg = yoy.groupBy("sell_id").agg(
        F.max_by(F.struct(F.col("growth_qty").alias("g"), F.col("qty_ly").alias("ly")), order).alias("pk"),
        F.percentile(F.when(pre, F.col("growth_qty")), F.lit(0.5)).alias("median_baseline"),
        F.avg(F.when(pre, F.col("growth_qty"))).alias("mean_baseline"),
        F.max(F.when(at_l, F.col("growth_qty"))).alias("latest_growth"),
        F.max(F.when(at_l, F.col("qty_ty"))).alias("latest_qty"),
    )
    return agg.select(
        "sell_id",
        F.col("pk.g").alias("peak_max_growth"),
        F.col("pk.ly").alias("max_qty_ly"),
        F.when(F.col("pk.g") < 0, 1).otherwise(0).alias("negative_impact"),
        "median_baseline", "mean_baseline", "latest_growth", "latest_qty",
    )


def peak_growth(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, *, shipments: bool = False) -> DataFrame:
    y, _, _ = series_with_status(t, cfg, ["complete"], shipments=shipments)
    p = peak_statistics(y, cfg)
    return p.select("sell_id",
                    *[F.round(c, 4).alias(c) for c in ["peak_max_growth", "max_qty_ly", "median_baseline",
                                                       "mean_baseline", "latest_growth", "latest_qty"]],
                    "negative_impact")


def ly_rolling_median(weekly: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG, k: int = 6) -> DataFrame:
    """Trailing k-row median of last year's quantity per series (NULL until k rows)."""
    ly = last_year(weekly, cfg)
    return rolling(ly, ["sell_id"], "week_of_year", "qty", k, "median",
                   out=f"qty_ly_roll{k}_median").select(
        "sell_id", "week_of_year", F.col("qty").alias("qty_ly"), f"qty_ly_roll{k}_median")


def rolling_median_6(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    out = ly_rolling_median(model_weekly(t, cfg), cfg, 6)
    return out.select("sell_id", "week_of_year", F.round("qty_ly", 4).alias("qty_ly"),
                      F.round("qty_ly_roll6_median", 4).alias("qty_ly_roll6_median"))
