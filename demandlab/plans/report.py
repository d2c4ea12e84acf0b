"""Corrections and the reporting table (actuals + forecasts).

Corrections are data (a rules list of (state, category, action)), compiled
on the driver into one ``when`` ladder per action -- the rules list is a run
parameter of a handful of rows, so no join is needed and the whole correction
step stays a single projection inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.operators.joins import attach_scalars
from demandlab.operators.windows import forward_fill, running_total
from demandlab.plans.forecast import forecast_adjusted, naive_rate_of_sale, ship_forecast_combined
from demandlab.plans.series import yoy_growth
from demandlab.sources.literals import DEFAULT_CORRECTIONS
from demandlab.sources.tables import Tables


def rule_match(rules, action: str) -> Column:
    conds = []
    for state, category, act in rules:
        if act != action:
            continue
        c = F.lit(True)
        if state is not None:
            c = c & (F.col("state") == F.lit(state))
        if category is not None:
            c = c & (F.col("category") == F.lit(category))
        conds.append(c)
    if not conds:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))


def typed_nulls(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with NULL columns of the names and types that only ``like`` has."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in like.schema if f.name not in df.columns})


def apply_ship_corrections(df: DataFrame, cfg: ModelConfig = DEFAULT_CONFIG, rules=DEFAULT_CORRECTIONS) -> DataFrame:
    """Shipment rules in reference order: hold the latest actual until the
    state's third milestone (incomplete series), double after L, set to last
    year, halve the gap to last year after L; forecasts before L are NULL.
    (The 'zero' rule is a POS rule, see ``actual_forecast_stitch``.)"""
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    fq = F.col("forecast_quantity")
    df = df.withColumn("__lq", F.when(wk == L, F.col("qty_ty")))
    df = df.withColumn("last_week_qty", forward_fill("__lq", ["sell_id"], "week_ending_date")).drop("__lq")
    hold = (rule_match(rules, "hold_last") & (F.col("common_product") == 0) & (wk >= L)
            & (wk < F.col("state_third_milestone_date")))
    df = df.withColumn("forecast_quantity", F.when(hold, F.col("last_week_qty")).otherwise(fq))
    df = df.withColumn("forecast_quantity", F.when(rule_match(rules, "double") & (wk > L), fq * 2).otherwise(fq))
    df = df.withColumn("forecast_quantity", F.when(rule_match(rules, "set_ly"), F.col("qty_ly")).otherwise(fq))
    df = df.withColumn("forecast_quantity", F.when(wk < L, F.lit(None).cast("double")).otherwise(fq))
    return df.withColumn("forecast_quantity",
                         F.when(rule_match(rules, "halve_gap") & (wk > L), fq - (fq - F.col("qty_ly")) / 2).otherwise(fq))


def retailer_corrections(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, rules=DEFAULT_CORRECTIONS) -> DataFrame:
    df = apply_ship_corrections(ship_forecast_combined(t, cfg), cfg, rules)
    return df.select("sell_id", "state", "category", "week_ending_date", "common_product", "qty_ty", "qty_ly",
                     "last_week_qty", "forecast_quantity", "promo_uplift", "dampen_multiplier", "promo_uplift_new")


def running_total_correction(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, rules=DEFAULT_CORRECTIONS) -> DataFrame:
    """Series under the 'cumulative' rule get the running total of their
    forecast (RANGE unbounded preceding .. current row, by week).  The
    corrected shipment results are a stage output: materialized once."""
    from demandlab.session import shared
    return shared(t, ("ship_results", cfg, tuple(rules)),
                  lambda: _running_total(t, cfg, rules))


def _running_total(t: Tables, cfg: ModelConfig, rules) -> DataFrame:
    df = retailer_corrections(t, cfg, rules)
    cum = running_total("forecast_quantity", ["sell_id"], "week_ending_date")
    return df.withColumn("forecast_quantity",
                         F.when(rule_match(rules, "cumulative"), cum).otherwise(F.col("forecast_quantity")))


def pos_forecasts(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Milestone (complete) + naive (incomplete) POS forecasts, one table."""
    common = forecast_adjusted(t, cfg).select(
        "sell_id", "state", "category", "week_ending_date", "qty_ly", "dollars_ly",
        "forecast1", "forecast_quantity", "promo_uplift")
    naive = naive_rate_of_sale(t, cfg).select(
        "sell_id", "state", "category", "week_ending_date", "qty_ly", "dollars_ly", "forecast_quantity")
    return common.unionByName(naive, allowMissingColumns=True)


def actual_forecast_stitch(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, rules=DEFAULT_CORRECTIONS) -> DataFrame:
    """Reporting table: the POS fact (actual weeks with LY alongside, plus the
    milestone marker rows) with forecasts attached.

    The latest actual week is the newest week among product rows (marker rows
    carry no category and are ignored).  That week carries both the actual
    and the forecast columns (for a continuous chart); forecast weeks after
    it are appended; last year's values missing on forecast weeks are filled
    from the forecast table; the 'zero' rule zeroes a category.
    """
    actuals = pos_fact_with_markers(t, cfg)
    latest = actuals.filter(F.col("category").isNotNull()).agg(F.max("week_ending_date").alias("latest_week"))
    fc = attach_scalars(pos_forecasts(t, cfg), latest)
    wk = F.col("week_ending_date")
    fnp = (fc.filter(wk >= F.col("latest_week"))
             .filter(F.col("state").isNotNull() & F.col("category").isNotNull())
             .select("sell_id", "state", "category", "week_ending_date", "latest_week",
                     F.col("forecast1").alias("forecast_percent"), "forecast_quantity",
                     F.col("qty_ly").alias("qty_ly_filled"), F.col("dollars_ly").alias("dollars_ly_filled"),
                     "promo_uplift"))
    a = attach_scalars(actuals, latest)
    part_a = (a.join(fnp.filter(wk == F.col("latest_week")).drop("latest_week", "promo_uplift", "state", "category"),
                     ["sell_id", "week_ending_date"], "left")
               .withColumn("promo_uplift", F.lit(0.0)))
    # forecast weeks have no actuals: typed NULLs
    part_b = typed_nulls(fnp.filter(wk > F.col("latest_week")), a)
    cols = ["sell_id", "state", "category", "week_ending_date", "qty_ty", "dollars_ty", "qty_ly", "dollars_ly",
            "marker_first", "marker_second", "marker_third",
            "forecast_percent", "forecast_quantity", "qty_ly_filled", "dollars_ly_filled", "promo_uplift", "latest_week"]
    s = part_a.select(*cols).unionByName(part_b.select(*cols))
    s = s.withColumns({
        "qty_ly": F.coalesce("qty_ly", "qty_ly_filled"),
        "dollars_ly": F.coalesce("dollars_ly", "dollars_ly_filled"),
        "promo_uplift": F.coalesce("promo_uplift", F.lit(0.0)),
    })
    zero = rule_match(rules, "zero") & F.col("forecast_quantity").isNotNull()
    s = s.withColumns({
        "forecast_quantity": F.when(zero, F.lit(0.0)).otherwise(F.col("forecast_quantity")),
        "promo_uplift": F.when(zero, F.lit(0.0)).otherwise(F.col("promo_uplift")),
    })
    s = s.withColumn("forecast_quantity",
                     F.when(wk == F.col("latest_week"), F.col("qty_ty")).otherwise(F.col("forecast_quantity")))
    return s.select("sell_id", "state", "category", "week_ending_date", "qty_ty", "dollars_ty", "qty_ly",
                    "dollars_ly", "forecast_percent", "forecast_quantity", "promo_uplift",
                    "marker_first", "marker_second", "marker_third")


def top_series(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, n: int = 10) -> DataFrame:
    """Top-n series by total TY quantity (ties: sell_id ascending).  The limit
    is the feature: Spark plans it as a per-partition top-n + final merge
    (TakeOrderedAndProject), never a full sort."""
    y = yoy_growth(t, cfg)
    return (y.groupBy("sell_id").agg(F.sum("qty_ty").alias("total_qty"))
             .orderBy(F.desc("total_qty"), F.asc("sell_id")).limit(n))


def exclude_series(df: DataFrame, pairs, spark) -> DataFrame:
    """Drop known-broken (state, category) series with a left anti join
    against the (small, literal) exclusion list."""
    if not pairs:
        return df
    ex = spark.createDataFrame(list(pairs), "state string, category string")
    return df.join(F.broadcast(ex), ["state", "category"], "left_anti")


def ship_actuals_dated(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Shipment actuals at the modelling grain, each TY week next to the same
    week last year (full outer, so last-year-only weeks are kept); weeks with
    no TY row take their date from the week-number -> week-ending map
    (forecast calendar, inner join: only calendar weeks are reported).
    This is the shipment actuals table of the reporting layer: materialized
    once (the stitch reads it three times)."""
    from demandlab.session import shared
    return shared(t, ("ship_actuals_dated", cfg), lambda: _ship_actuals_dated(t, cfg))


def _ship_actuals_dated(t: Tables, cfg: ModelConfig) -> DataFrame:
    from demandlab.plans.external import forecast_calendar
    from demandlab.plans.series import model_weekly
    w = model_weekly(t, cfg, shipments=True)
    curr = w.select((F.col("year") - 1).alias("year"), "week_of_year", "sell_id", "state", "category",
                    "week_ending_date", F.col("qty").alias("qty"), F.col("dollars").alias("dollars"))
    prev = w.select("year", "week_of_year", "sell_id", "state", "category",
                    F.col("qty").alias("stly_qty"), F.col("dollars").alias("stly_dollars"))
    j = curr.join(prev, ["year", "week_of_year", "sell_id", "state", "category"], "full") \
        .filter(F.col("year") == cfg.ly_year)
    cal = F.broadcast(forecast_calendar(t, cfg).select("week_of_year", F.col("week_ending_date").alias("date_ref")))
    return (j.join(cal, "week_of_year", "inner")
             .withColumn("week_ending_date", F.coalesce("week_ending_date", "date_ref"))
             .drop("date_ref", "year"))


def ship_actual_forecast_stitch(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG, rules=DEFAULT_CORRECTIONS) -> DataFrame:
    """Shipment reporting table: actuals through the latest week (with the
    forecast at the latest week), forecasts after it, last year's values
    filled from the model, last year's columns re-attached with a full outer
    join, and broken series excluded."""
    act = ship_actuals_dated(t, cfg)
    fc = running_total_correction(t, cfg, rules).select(
        "sell_id", "state", "category", "week_ending_date", "forecast_quantity",
        F.col("qty_ly").alias("qty_ly_filled"), F.col("promo_uplift_new").alias("promo_uplift"))
    wk, L = F.col("week_ending_date"), F.lit(cfg.latest_week)
    fnp = fc.filter((wk >= L) & F.col("state").isNotNull() & F.col("category").isNotNull())
    cols = ["sell_id", "state", "category", "week_ending_date", "qty", "dollars", "stly_qty", "stly_dollars",
            "forecast_quantity", "qty_ly_filled", "promo_uplift"]
    part_a = (act.filter(wk <= L)
                 .join(fnp.filter(wk == L).drop("state", "category", "promo_uplift"),
                       ["sell_id", "week_ending_date"], "left")
                 .withColumn("promo_uplift", F.lit(0.0)))
    part_b = typed_nulls(fnp.filter(wk > L), act)
    s = part_a.select(*cols).unionByName(part_b.select(*cols))
    s = s.withColumns({
        "stly_qty": F.coalesce("stly_qty", "qty_ly_filled"),
        "forecast_quantity": F.when(wk == L, F.col("qty")).otherwise(F.col("forecast_quantity")),
        "promo_uplift": F.coalesce("promo_uplift", F.lit(0.0)),
    }).drop("qty_ly_filled")
    ly = act.select("sell_id", "state", "category", "week_ending_date",
                    F.col("stly_qty").alias("ly_qty"), F.col("stly_dollars").alias("ly_dollars"))
    s = (s.drop("stly_qty", "stly_dollars")
          .join(ly, ["sell_id", "state", "category", "week_ending_date"], "full")
          .withColumn("promo_uplift", F.coalesce("promo_uplift", F.lit(0.0))))
    return exclude_series(s, cfg.excluded_series, t.spark)


MARKERS = {"first": "marker_first", "second": "marker_second", "third": "marker_third"}


def pos_fact_with_markers(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """The POS reporting fact (TY weeks with LY alongside) plus one marker row
    per state and milestone week, each flagging 2.0 in its own marker column.

    The frames are aligned by name: columns missing on one side become typed
    NULLs (``unionByName(allowMissingColumns=True)``), not positional unions.
    """
    from demandlab.plans.forecast import milestone_markers
    fact = yoy_growth(t, cfg).select("sell_id", "state", "category", "week_of_year", "week_ending_date",
                                     "qty_ty", "dollars_ty", "qty_ly", "dollars_ly")
    m = milestone_markers(t, cfg)
    marks = [m.filter(F.col("marker") == name)
              .select("state", F.col("marker_date").alias("week_ending_date"), F.lit(2.0).alias(col))
             for name, col in MARKERS.items()]
    out = fact
    for frame in marks:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def ship_coverage(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Share of shipment series and quantity that the reported model output
    (without the excluded series) covers as common (milestone) or non-common
    (naive), doesn't cover, or has alone: a full outer join of the id sets."""
    from demandlab.plans.series import model_weekly
    main = (model_weekly(t, cfg, shipments=True).groupBy("sell_id")
            .agg(F.sum("qty").alias("qty")))
    output = exclude_series(ship_forecast_combined(t, cfg), cfg.excluded_series, t.spark)
    modeled = output.select("sell_id", "common_product").distinct().withColumn("modeled", F.lit(True))
    j = main.withColumn("sold", F.lit(True)).join(modeled, "sell_id", "full")
    status = (F.when(F.col("sold").isNull(), "model_only").when(F.col("common_product") == 1, "common")
              .when(F.col("modeled"), "non_common").otherwise("not_modeled"))
    j = j.withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    per = j.groupBy(status.alias("coverage")).agg(F.count(F.lit(1)).alias("n_series"), F.sum("qty").alias("qty"))
    tot = per.agg(F.sum("n_series").alias("all_series"), F.sum("qty").alias("all_qty"))
    per = attach_scalars(per, tot)
    return per.select("coverage", F.col("n_series").cast("long").alias("n_series"), F.round("qty", 4).alias("qty"),
                      F.round(100.0 * F.col("n_series") / F.col("all_series"), 4).alias("pct_series"),
                      F.round(F.try_divide(100.0 * F.col("qty"), F.col("all_qty")), 4).alias("pct_qty"))
