"""Query registry: one Spark query and one oracle SQL per operator key.

Each Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver tables.  Double outputs are rounded to 4 places on both sides so
that summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlab.config import DEFAULT_CONFIG as CFG
from demandlab import oracle_sql as O
from demandlab.oracle_sql import FACT, d, wk, with_
from demandlab.plans import facts, series
from demandlab.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def _scratch(spark, name: str) -> str:
    """A new folder's path below the cluster's shared folder."""
    import uuid

    from demandlab.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/demandlab-{name}-{uuid.uuid4().hex}"


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# ---------------------------------------------------------------- step 1 ----

@register("weekly_sales", with_(FACT, O.weekly_cte("w", channel=True)) + """
SELECT week_ending_date, retailer, state, business, category, brand, ppg, channel,
       round(qty, 4) AS qty, round(dollars, 4) AS dollars, week_of_year, year FROM w""")
def q_weekly_sales(spark, sf_dir):
    return round_doubles(facts.weekly_sales(_t(spark, sf_dir), CFG, with_channel=True))


@register("week_ending_rules", f"""
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS sale_date FROM lineitem)
SELECT sale_date,
       CAST(sale_date + CAST(CASE WHEN dayofweek(sale_date) = 6 THEN 7 ELSE 6 - dayofweek(sale_date) END AS INTEGER) AS DATE) AS we_next,
       {wk('sale_date')} AS we_same_or_next,
       {O.wk_monday('sale_date')} AS we_monday_week,
       CAST(week(sale_date) AS INTEGER) AS week_of_year,
       CAST(year(sale_date) AS INTEGER) AS year,
       'q' || CAST(quarter(sale_date) AS VARCHAR) AS quarter,
       CAST(month(sale_date) AS INTEGER) AS month
FROM days""")
def q_week_ending_rules(spark, sf_dir):
    from demandlab.functions.dates import week_ending, with_date_meta
    days = _t(spark, sf_dir).lineitem.select(F.to_date("l_shipdate").alias("sale_date")).distinct()
    out = days.select(
        "sale_date",
        week_ending("sale_date", "next").alias("we_next"),
        week_ending("sale_date", "same_or_next").alias("we_same_or_next"),
        week_ending("sale_date", "monday_week").alias("we_monday_week"),
        F.weekofyear("sale_date").alias("week_of_year"),
    )
    return with_date_meta(out, "sale_date").select(
        "sale_date", "we_next", "we_same_or_next", "we_monday_week", "week_of_year", "year", "quarter", "month")


@register("channel_totals", with_(FACT) + f"""
SELECT t.year, t.channel, round(t.qty, 4) AS qty, round(t.dollars, 4) AS dollars, t.n_lines, m.channel_desc
FROM (SELECT CAST(year({wk('sale_date')}) AS INTEGER) AS year, channel,
             sum(qty) AS qty, sum(dollars) AS dollars, count(*) AS n_lines
      FROM fact GROUP BY ALL) t
LEFT JOIN (VALUES ('AF', 'Accepted Fulfilled'), ('AO', 'Accepted Open'), ('NF', 'Normal Fulfilled'),
                  ('NO', 'Normal Open'), ('RF', 'Returned Fulfilled'), ('RO', 'Returned Open')) m(channel, channel_desc)
  ON t.channel = m.channel""")
def q_channel_totals(spark, sf_dir):
    return round_doubles(facts.channel_totals(_t(spark, sf_dir), CFG))


# ---------------------------------------------------------------- step 2 ----

@register("business_filtered_sales", with_(FACT, O.weekly_cte("w", channel=False)) + f"""
SELECT week_ending_date, retailer, state, business, category, brand, ppg,
       round(qty, 4) AS qty, round(dollars, 4) AS dollars, week_of_year, year,
       coalesce(business, 'None') || '_' || coalesce(category, 'None') || '_' || coalesce(brand, 'None') || '_' ||
       coalesce(ppg, 'None') || '_' || coalesce(state, 'None') || '_' || coalesce(retailer, 'None') AS sell_id
FROM w
WHERE week_ending_date > {d(CFG.history_start)}
  AND category NOT IN ('PROMO')
  AND NOT (ppg = '' OR ppg IS NULL)
  AND NOT (business = '' AND category = '' AND brand = '' AND ppg <> '')
  AND dollars > 0 AND qty > 0
  AND NOT (dollars IS NULL AND qty IS NULL)""")
def q_business_filtered_sales(spark, sf_dir):
    return round_doubles(facts.business_filtered_sales(_t(spark, sf_dir), CFG, excluded_categories=("PROMO",)))


def _loss_sql(shipments: bool = True) -> str:
    steps = [
        ("history_start", f"week_ending_date > {d(CFG.history_start)}"),
        ("training_end", f"week_ending_date <= {d(CFG.latest_week)}"),
        ("category", "category NOT IN ('PROMO')"),
        ("ppg_blank", "NOT (ppg = '' OR ppg IS NULL)"),
        ("blank_hierarchy", "NOT (business = '' AND category = '' AND brand = '' AND ppg <> '')"),
        ("returns", "dollars >= 0 AND qty >= 0" if shipments else "dollars > 0 AND qty > 0"),
        ("null_sales", "NOT (dollars IS NULL AND qty IS NULL)"),
    ]
    if not shipments:
        steps.pop(1)
    cols = ["count(*) AS rows_0", "sum(qty) AS qty_0", "sum(dollars) AS dollars_0"]
    cum = []
    for i, (_, p) in enumerate(steps, start=1):
        cum.append(f"coalesce({p}, false)")
        c = " AND ".join(cum)
        cols += [f"count(*) FILTER (WHERE {c}) AS rows_{i}",
                 f"sum(qty) FILTER (WHERE {c}) AS qty_{i}",
                 f"sum(dollars) FILTER (WHERE {c}) AS dollars_{i}"]
    pct = lambda a, b: f"round(coalesce(100.0 * ({a} - {b}) / nullif({a}, 0), 0.0), 4)"
    unions = "\nUNION ALL\n".join(
        f"SELECT {i} AS step, '{name}' AS filter_name, CAST(rows_{i-1} AS BIGINT) AS rows_before, "
        f"CAST(rows_{i} AS BIGINT) AS rows_after, {pct(f'rows_{i-1}', f'rows_{i}')} AS pct_rows_lost, "
        f"{pct(f'qty_{i-1}', f'qty_{i}')} AS pct_qty_lost, {pct(f'dollars_{i-1}', f'dollars_{i}')} AS pct_dollars_lost FROM agg"
        for i, (name, _) in enumerate(steps, start=1))
    return with_(FACT, O.weekly_cte("w", channel=shipments), "agg AS (SELECT " + ",\n ".join(cols) + " FROM w)") + unions


@register("filter_loss_report", _loss_sql())
def q_filter_loss_report(spark, sf_dir):
    return facts.filter_loss_report(_t(spark, sf_dir), CFG, excluded_categories=("PROMO",))


@register("filter_loss_report_pos", _loss_sql(shipments=False))
def q_filter_loss_report_pos(spark, sf_dir):
    return facts.filter_loss_report(_t(spark, sf_dir), CFG, excluded_categories=("PROMO",), shipments=False)


@register("yoy_growth", with_(FACT, O.model_weekly_cte(CFG), O.yoy_cte(CFG)) + """
SELECT sell_id, state, category, week_ending_date, week_of_year,
       round(qty_ty, 4) AS qty_ty, round(dollars_ty, 4) AS dollars_ty,
       round(qty_ly, 4) AS qty_ly, round(dollars_ly, 4) AS dollars_ly,
       round(growth_qty, 4) AS growth_qty, round(growth_sales, 4) AS growth_sales
FROM yoy""")
def q_yoy_growth(spark, sf_dir):
    return round_doubles(series.yoy_growth(_t(spark, sf_dir), CFG))


_YOY_KEYS = ["retailer", "state", "business", "category", "brand", "ppg", "channel"]


_ISO_YEAR = "wi AS (SELECT * REPLACE (CAST(isoyear(week_ending_date) AS INTEGER) AS year) FROM w)"


@register("yoy_full_outer", with_(FACT, O.weekly_cte("w0", channel=True), "w AS (SELECT week_ending_date, week_of_year, year, qty, dollars, "
                                  + ", ".join(f"coalesce({k}, 'Null_Value') AS {k}" for k in _YOY_KEYS) + " FROM w0)", _ISO_YEAR) + f"""
SELECT coalesce(c.year, p.year) AS year, coalesce(c.week_of_year, p.week_of_year) AS week_of_year,
       {", ".join(f"coalesce(c.{k}, p.{k}) AS {k}" for k in _YOY_KEYS)},
       c.week_ending_date, round(c.qty, 4) AS qty, round(c.dollars, 4) AS dollars,
       round(p.qty, 4) AS stly_qty, round(p.dollars, 4) AS stly_dollars
FROM (SELECT year - 1 AS year, * EXCLUDE (year) FROM wi) c
FULL OUTER JOIN wi p
  ON c.year = p.year AND c.week_of_year = p.week_of_year AND {" AND ".join(f"c.{k} = p.{k}" for k in _YOY_KEYS)}""")
def q_yoy_full_outer(spark, sf_dir):
    return round_doubles(series.yoy_full_outer(_t(spark, sf_dir), CFG))


@register("yoy_category", with_(FACT, O.weekly_cte("w0", channel=True), """w AS (
  SELECT week_ending_date, week_of_year, year, coalesce(state, 'Null_Value') AS state, coalesce(business, 'Null_Value') AS business,
         CASE WHEN category IS NULL OR category = 'SMALL' THEN 'Null_Value' ELSE category END AS category,
         sum(qty) AS qty, sum(dollars) AS dollars FROM w0 GROUP BY ALL)""", _ISO_YEAR) + """
SELECT coalesce(c.year, p.year) AS year, coalesce(c.week_of_year, p.week_of_year) AS week_of_year,
       coalesce(c.state, p.state) AS state, coalesce(c.business, p.business) AS business, coalesce(c.category, p.category) AS category,
       c.week_ending_date, round(c.qty, 4) AS qty, round(c.dollars, 4) AS dollars,
       round(p.qty, 4) AS stly_qty, round(p.dollars, 4) AS stly_dollars
FROM (SELECT year - 1 AS year, * EXCLUDE (year) FROM wi) c
FULL OUTER JOIN wi p USING (year, week_of_year, state, business, category)""")
def q_yoy_category(spark, sf_dir):
    return round_doubles(series.yoy_category(_t(spark, sf_dir), CFG))


@register("lifespan_split", with_(FACT, O.model_weekly_cte(CFG), O.lifespan_cte(CFG)) + "SELECT * FROM lifespan")
def q_lifespan_split(spark, sf_dir):
    return series.lifespan_split(_t(spark, sf_dir), CFG)


@register("lifespan_split_ship", with_(FACT, O.model_weekly_cte(CFG, shipments=True), O.lifespan_cte(CFG, shipments=True))
          + "SELECT * FROM lifespan")
def q_lifespan_split_ship(spark, sf_dir):
    return series.lifespan_split(_t(spark, sf_dir), CFG, shipments=True)


@register("series_coverage", with_(FACT, O.model_weekly_cte(CFG), O.lifespan_cte(CFG)) + f"""
, per AS (
  SELECT s.status, count(*) AS n_series, sum(t.qty) AS qty_ty, sum(t.dollars) AS dollars_ty
  FROM lifespan s
  LEFT JOIN (SELECT sell_id, sum(qty) AS qty, sum(dollars) AS dollars FROM mw WHERE year = {CFG.ty_year} GROUP BY sell_id) t
    ON s.sell_id = t.sell_id
  GROUP BY s.status
)
SELECT status, CAST(n_series AS BIGINT) AS n_series, round(qty_ty, 4) AS qty_ty, round(dollars_ty, 4) AS dollars_ty,
       round(100.0 * n_series / sum(n_series) OVER (), 4) AS pct_series,
       round(100.0 * qty_ty / sum(qty_ty) OVER (), 4) AS pct_qty
FROM per""")
def q_series_coverage(spark, sf_dir):
    return series.series_coverage(_t(spark, sf_dir), CFG)


@register("peak_growth", with_(FACT, O.model_weekly_cte(CFG), O.yoy_cte(CFG), O.lifespan_cte(CFG),
                               "yoy_c AS (SELECT * FROM yoy WHERE sell_id IN (SELECT sell_id FROM lifespan WHERE status = 'complete'))",
                               O.peak_cte(CFG)) + """
SELECT sell_id, round(peak_max_growth, 4) AS peak_max_growth, round(max_qty_ly, 4) AS max_qty_ly,
       round(median_baseline, 4) AS median_baseline, round(mean_baseline, 4) AS mean_baseline,
       round(latest_growth, 4) AS latest_growth, round(latest_qty, 4) AS latest_qty, negative_impact
FROM peak""")
def q_peak_growth(spark, sf_dir):
    return series.peak_growth(_t(spark, sf_dir), CFG)


@register("rolling_median_6", with_(FACT, O.model_weekly_cte(CFG)) + f"""
SELECT sell_id, week_of_year, round(qty, 4) AS qty_ly,
       round(CASE WHEN count(qty) OVER w = 6 THEN quantile_cont(qty, 0.5) OVER w END, 4) AS qty_ly_roll6_median
FROM mw WHERE year = {CFG.ly_year}
WINDOW w AS (PARTITION BY sell_id ORDER BY week_of_year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def q_rolling_median_6(spark, sf_dir):
    return series.rolling_median_6(_t(spark, sf_dir), CFG)


# ---------------------------------------------------------------- step 4-6 ----

from demandlab.plans import forecast as FC  # noqa: E402
from demandlab.plans import report as RP  # noqa: E402
from demandlab.sources.literals import DEFAULT_CORRECTIONS  # noqa: E402

_POS = O.model_base(CFG)
_SHIP = O.model_base(CFG, shipments=True)


def _sel(df: DataFrame, cols) -> DataFrame:
    return round_doubles(df.select(*cols))


_GRID_COLS = ["sell_id", "state", "category", "week_ending_date", "week_of_year", "n_actual_weeks", "qty_ty", "dollars_ty"]


@register("weekly_grid", with_(*_POS) + f"""
SELECT k.sell_id, k.state, k.category, c.week_ending_date, c.week_of_year, CAST(k.n AS BIGINT) AS n_actual_weeks,
       round(CASE WHEN c.week_ending_date <= {d(CFG.latest_week)} THEN coalesce(m.qty, 0.0) ELSE m.qty END, 4) AS qty_ty,
       round(CASE WHEN c.week_ending_date <= {d(CFG.latest_week)} THEN coalesce(m.dollars, 0.0) ELSE m.dollars END, 4) AS dollars_ty
FROM (SELECT sell_id, state, category, count(*) AS n FROM mw WHERE year = {CFG.ty_year} GROUP BY ALL) k
CROSS JOIN cal c
LEFT JOIN (SELECT * FROM mw WHERE year = {CFG.ty_year}) m ON m.sell_id = k.sell_id AND m.week_ending_date = c.week_ending_date""")
def q_weekly_grid(spark, sf_dir):
    return _sel(FC.weekly_grid(_t(spark, sf_dir), CFG), _GRID_COLS)


@register("fill_attributes", with_(*_POS) + """
, g AS (
  SELECT k.sell_id, c.week_ending_date, c.week_of_year, y.state, y.category, y.qty_ty
  FROM (SELECT sell_id FROM lifespan WHERE status IN ('incomplete', 'missing')) k
  CROSS JOIN cal c
  LEFT JOIN yoy y ON y.sell_id = k.sell_id AND y.week_ending_date = c.week_ending_date
)
SELECT sell_id, week_ending_date, week_of_year, round(qty_ty, 4) AS qty_ty,
       coalesce(last_value(state IGNORE NULLS) OVER fw, first_value(state IGNORE NULLS) OVER bw) AS state,
       coalesce(last_value(category IGNORE NULLS) OVER fw, first_value(category IGNORE NULLS) OVER bw) AS category,
       round(last_value(qty_ty IGNORE NULLS) OVER fw, 4) AS qty_ty_ffill
FROM g
WINDOW fw AS (PARTITION BY sell_id ORDER BY week_ending_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       bw AS (PARTITION BY sell_id ORDER BY week_ending_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def q_fill_attributes(spark, sf_dir):
    return round_doubles(FC.fill_attributes(_t(spark, sf_dir), CFG))


_NAIVE_D = ["qty_ty", "dollars_ty", "qty_ly", "dollars_ly", "pos_actuals_avg", "forecast_quantity"]
_NAIVE_O = ["sell_id", "state", "category", "week_ending_date", "week_of_year"]


@register("naive_rate_of_sale", with_(*_POS, O.naive_pos_cte(CFG)) + O.round_select(_NAIVE_D, _NAIVE_O, "np"))
def q_naive_rate_of_sale(spark, sf_dir):
    return _sel(FC.naive_rate_of_sale(_t(spark, sf_dir), CFG), _NAIVE_O + _NAIVE_D)


_NSC_D = ["qty_ty", "dollars_ty", "qty_ly", "qty_ly_centered7_mean", "med_qty_diff", "forecast_quantity"]
_NSC_O = ["sell_id", "state", "category", "week_ending_date", "week_of_year", "common_product"]


@register("naive_centered_mean", with_(*_SHIP, O.naive_ship_cte(CFG)) + O.round_select(_NSC_D, _NSC_O, "nsc"))
def q_naive_centered_mean(spark, sf_dir):
    return _sel(FC.naive_centered_mean(_t(spark, sf_dir), CFG), _NSC_O + _NSC_D)


@register("projection_milestones", with_(O.projection_cte(CFG)) + """
SELECT state, peak_day, CAST(peak_value AS BIGINT) AS peak_value, fall_day, crossed, national_peak_day FROM pm0 CROSS JOIN pn""")
def q_projection_milestones(spark, sf_dir):
    from demandlab.plans.milestones import projection_milestones
    return projection_milestones(_t(spark, sf_dir), CFG)


_MS_COLS = ["state", "first_milestone_date", "thirty_pct_week", "pos_second_milestone_date", "pos_third_milestone_date",
            "pos_weeks_to_second", "fc_type", "ship_second_milestone_date", "ship_third_milestone_date"]


@register("state_milestones", with_(O.ms_cte(CFG)) + "SELECT " + ", ".join(_MS_COLS) + " FROM ms")
def q_state_milestones(spark, sf_dir):
    return FC.state_milestones(_t(spark, sf_dir), CFG).select(*_MS_COLS)


@register("milestone_markers", with_(O.ms_cte(CFG)) + """
SELECT state, marker, marker_date, CAST(week(marker_date) AS INTEGER) AS week_of_year FROM (
  SELECT state, 'first' AS marker, first_milestone_date AS marker_date FROM ms
  UNION ALL SELECT state, 'second', pos_second_milestone_date FROM ms
  UNION ALL SELECT state, 'third', pos_third_milestone_date FROM ms) x""")
def q_milestone_markers(spark, sf_dir):
    return FC.milestone_markers(_t(spark, sf_dir), CFG)


_MP_D = ["qty_ty", "dollars_ty", "growth_qty", "growth_sales", "forecast1", "forecast_quantity", "median_baseline"]
_MP_O = ["sell_id", "state", "category", "week_ending_date", "week_of_year", "first_milestone_date",
         "second_milestone_date", "third_milestone_date", "negative_impact"]


@register("milestone_forecast_pos", with_(*_POS, *O.milestone_ctes(CFG)) + O.round_select(_MP_D, _MP_O + ["fc_type"], "mp"))
def q_milestone_forecast_pos(spark, sf_dir):
    return _sel(FC.milestone_forecast_pos(_t(spark, sf_dir), CFG), _MP_O + ["fc_type"] + _MP_D)


@register("milestone_forecast_ship", with_(*_SHIP, *O.milestone_ctes(CFG, shipments=True))
          + O.round_select(_MP_D + ["peak_max_growth", "max_qty_ly"], _MP_O, "mp"))
def q_milestone_forecast_ship(spark, sf_dir):
    return _sel(FC.milestone_forecast_ship(_t(spark, sf_dir), CFG), _MP_O + _MP_D + ["peak_max_growth", "max_qty_ly"])


@register("trend_seasonal_forecast", with_(FACT, O.model_weekly_cte(CFG), *O.seasonal_ctes(CFG))
          + O.round_select(["seasonal_forecast"], ["sell_id", "week_ending_date", "week_of_year"], "sfc"))
def q_trend_seasonal_forecast(spark, sf_dir):
    return round_doubles(FC.trend_seasonal_model(_t(spark, sf_dir), CFG))


@register("high_growth_flag", with_(FACT, O.model_weekly_cte(CFG), *O.seasonal_ctes(CFG))
          + O.round_select(["mean_pct_diff"], ["sell_id", "high_growth_decline"], "hgf"))
def q_high_growth_flag(spark, sf_dir):
    return round_doubles(FC.high_growth_flags(_t(spark, sf_dir), CFG))


_ADJ_D = ["qty_ty", "qty_ly", "dollars_ly", "qty_rolling_6_week_med", "max_qty_ly", "forecast1", "forecast_quantity",
          "forecast_growth", "promo_uplift", "median_baseline"]
_ADJ_O = ["sell_id", "state", "category", "week_ending_date", "week_of_year", "first_milestone_date",
          "second_milestone_date", "third_milestone_date", "negative_impact", "high_growth_decline"]


@register("forecast_adjusted", with_(*_POS, *O.adjusted_ctes(CFG)) + O.round_select(_ADJ_D, _ADJ_O, "adj"))
def q_forecast_adjusted(spark, sf_dir):
    return _sel(FC.forecast_adjusted(_t(spark, sf_dir), CFG), _ADJ_O + _ADJ_D)


@register("promo_uplift", with_(*_SHIP, *O.adjusted_ctes(CFG, shipments=True)) + O.round_select(_ADJ_D, _ADJ_O, "adj"))
def q_promo_uplift(spark, sf_dir):
    return _sel(FC.ship_forecast_adjusted(_t(spark, sf_dir), CFG), _ADJ_O + _ADJ_D)


_COMB_D = ["qty_ty", "qty_ly", "qty_rolling_6_week_med", "forecast_quantity", "promo_uplift", "dampen_multiplier",
           "promo_uplift_new"]
_COMB_O = ["sell_id", "state", "category", "week_ending_date", "week_of_year", "common_product", "state_third_milestone_date"]
_SHIP_ALL = [*_SHIP, *O.adjusted_ctes(CFG, shipments=True), O.naive_ship_cte(CFG), O.combined_cte(CFG)]


@register("promo_dampened", with_(*_SHIP_ALL, "combx AS (SELECT *, promo_uplift * dampen_multiplier AS promo_uplift_new FROM comb)")
          + O.round_select(_COMB_D, _COMB_O, "combx"))
def q_promo_dampened(spark, sf_dir):
    return _sel(FC.ship_forecast_combined(_t(spark, sf_dir), CFG), _COMB_O + _COMB_D)


_CORR_D = ["qty_ty", "qty_ly", "last_week_qty", "forecast_quantity", "promo_uplift", "dampen_multiplier", "promo_uplift_new"]
_CORR_O = ["sell_id", "state", "category", "week_ending_date", "common_product"]


@register("retailer_corrections", with_(*_SHIP_ALL, O.corrections_cte(CFG, DEFAULT_CORRECTIONS))
          + O.round_select(_CORR_D, _CORR_O, "corr"))
def q_retailer_corrections(spark, sf_dir):
    return _sel(RP.retailer_corrections(_t(spark, sf_dir), CFG), _CORR_O + _CORR_D)


_RT = f"""rt AS (SELECT * REPLACE (CASE WHEN {O.rule_sql(DEFAULT_CORRECTIONS, 'cumulative')}
  THEN sum(forecast_quantity) OVER (PARTITION BY sell_id ORDER BY week_ending_date
                                    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  ELSE forecast_quantity END AS forecast_quantity) FROM corr)"""


@register("running_total_correction", with_(*_SHIP_ALL, O.corrections_cte(CFG, DEFAULT_CORRECTIONS), _RT)
          + O.round_select(_CORR_D, _CORR_O, "rt"))
def q_running_total_correction(spark, sf_dir):
    return _sel(RP.running_total_correction(_t(spark, sf_dir), CFG), _CORR_O + _CORR_D)


_ST_D = ["qty_ty", "dollars_ty", "qty_ly", "dollars_ly", "forecast_percent", "forecast_quantity", "promo_uplift",
         "marker_first", "marker_second", "marker_third"]
_ST_O = ["sell_id", "state", "category", "week_ending_date"]
_ZERO = O.rule_sql(DEFAULT_CORRECTIONS, "zero")


@register("actual_forecast_stitch", with_(*_POS, *O.adjusted_ctes(CFG), O.naive_pos_cte(CFG), f"""
fcu AS (
  SELECT sell_id, state, category, week_ending_date, qty_ly, dollars_ly, forecast1, forecast_quantity, promo_uplift FROM adj
  UNION ALL
  SELECT sell_id, state, category, week_ending_date, qty_ly, dollars_ly, NULL, forecast_quantity, NULL FROM np
),
{O.PFM},
lw AS (SELECT max(week_ending_date) AS latest_week FROM pfm WHERE category IS NOT NULL),
fnp AS (
  SELECT f.sell_id, f.state, f.category, f.week_ending_date, lw.latest_week, f.forecast1 AS forecast_percent,
         f.forecast_quantity, f.qty_ly AS qty_ly_filled, f.dollars_ly AS dollars_ly_filled, f.promo_uplift
  FROM fcu f CROSS JOIN lw
  WHERE f.week_ending_date >= lw.latest_week AND f.state IS NOT NULL AND f.category IS NOT NULL
),
pa AS (
  SELECT a.sell_id, a.state, a.category, a.week_ending_date, a.qty_ty, a.dollars_ty, a.qty_ly, a.dollars_ly,
         a.marker_first, a.marker_second, a.marker_third,
         f.forecast_percent, f.forecast_quantity, f.qty_ly_filled, f.dollars_ly_filled, 0.0 AS promo_uplift, lw.latest_week
  FROM pfm a CROSS JOIN lw
  LEFT JOIN (SELECT * FROM fnp WHERE week_ending_date = latest_week) f
    ON f.sell_id = a.sell_id AND f.week_ending_date = a.week_ending_date
),
pb AS (
  SELECT f.sell_id, f.state, f.category, f.week_ending_date, a.qty_ty, a.dollars_ty, a.qty_ly, a.dollars_ly,
         a.marker_first, a.marker_second, a.marker_third,
         f.forecast_percent, f.forecast_quantity, f.qty_ly_filled, f.dollars_ly_filled, f.promo_uplift, f.latest_week
  FROM (SELECT * FROM fnp WHERE week_ending_date > latest_week) f
  LEFT JOIN (SELECT * FROM pfm WHERE week_ending_date < (SELECT latest_week FROM lw)) a
    ON a.sell_id = f.sell_id AND a.week_ending_date = f.week_ending_date
),
s0 AS (
  SELECT sell_id, state, category, week_ending_date, qty_ty, dollars_ty,
         coalesce(qty_ly, qty_ly_filled) AS qty_ly, coalesce(dollars_ly, dollars_ly_filled) AS dollars_ly,
         marker_first, marker_second, marker_third,
         forecast_percent, forecast_quantity, coalesce(promo_uplift, 0.0) AS promo_uplift, latest_week
  FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) u
),
s1 AS (
  SELECT * REPLACE (
    CASE WHEN week_ending_date = latest_week THEN qty_ty
         WHEN {_ZERO} AND forecast_quantity IS NOT NULL THEN 0.0 ELSE forecast_quantity END AS forecast_quantity,
    CASE WHEN {_ZERO} AND forecast_quantity IS NOT NULL THEN 0.0 ELSE promo_uplift END AS promo_uplift)
  FROM s0
)""") + O.round_select(_ST_D, _ST_O, "s1"))
def q_actual_forecast_stitch(spark, sf_dir):
    return _sel(RP.actual_forecast_stitch(_t(spark, sf_dir), CFG), _ST_O + _ST_D)


@register("top_series", with_(FACT, O.model_weekly_cte(CFG), O.yoy_cte(CFG)) + """
SELECT sell_id, round(sum(qty_ty), 4) AS total_qty FROM yoy GROUP BY sell_id
ORDER BY sum(qty_ty) DESC, sell_id LIMIT 10""")
def q_top_series(spark, sf_dir):
    return round_doubles(RP.top_series(_t(spark, sf_dir), CFG))


# ---------------------------------------------------------------- step 3 ----

from demandlab.plans import external as X  # noqa: E402


@register("geo_filtered", with_(O.GEO, O.sd_cte(CFG)) + """
SELECT s.state, g.state_initial, s.date, s.n_orders, round(s.order_value, 4) AS order_value, s.urgent_orders,
       round(s.avg_value, 4) AS avg_value, g.country
FROM sd s JOIN geo g ON g.state = s.state WHERE g.country = 'AMERICA'""")
def q_geo_filtered(spark, sf_dir):
    return round_doubles(X.geo_filtered(_t(spark, sf_dir), CFG))


@register("state_coverage_check", with_(O.GEO, O.sd_cte(CFG)) + """
, a AS (SELECT DISTINCT s.state AS value FROM sd s JOIN geo g ON g.state = s.state WHERE g.country = 'AMERICA'),
b AS (SELECT DISTINCT state AS value FROM geo)
SELECT coalesce(a.value, b.value) AS value, a.value IS NOT NULL AS in_data, b.value IS NOT NULL AS in_lookup
FROM a FULL OUTER JOIN b ON a.value = b.value
WHERE a.value IS NULL OR b.value IS NULL""")
def q_state_coverage_check(spark, sf_dir):
    from demandlab.operators.quality import coverage_gaps
    t = _t(spark, sf_dir)
    return coverage_gaps(X.geo_filtered(t, CFG), X.geography(t), "state")


@register("drop_constant_columns", with_(O.GEO, O.sd_cte(CFG)) + """
SELECT s.state, g.state_initial, s.date, s.n_orders, round(s.order_value, 4) AS order_value, s.urgent_orders,
       round(s.avg_value, 4) AS avg_value
FROM sd s JOIN geo g ON g.state = s.state WHERE g.country = 'AMERICA'""")
def q_drop_constant_columns(spark, sf_dir):
    from demandlab.operators.reshape import drop_all_null_rows, drop_constant_columns
    return round_doubles(drop_all_null_rows(drop_constant_columns(X.geo_filtered(_t(spark, sf_dir), CFG))))


@register("rolling_mean_by_state", with_(O.GEO, O.sd_cte(CFG), O.rm_cte()) + O.round_select(
    ["urgent_orders_baseline", "orders_baseline", "urgent_orders_baseline_6_roll_mean", "orders_baseline_6_roll_mean"],
    ["state", "state_initial", "date"], "rm"))
def q_rolling_mean_by_state(spark, sf_dir):
    return round_doubles(X.rolling_mean_by_state(_t(spark, sf_dir), CFG))


@register("per_million_features", with_(O.GEO, O.sd_cte(CFG), O.POP, O.pm_cte()) + O.round_select(
    ["orders_increase", "urgent_increase", "order_value", "state_pop_mil", "orders_increase_per_mil",
     "urgent_increase_per_mil"],
    ["state", "state_initial", "date", "state_pop", "quarter", "month", "year"], "pm"))
def q_per_million_features(spark, sf_dir):
    return round_doubles(X.per_million_features(_t(spark, sf_dir), CFG))


@register("policy_duration", with_(O.GEO, O.ps_cte(CFG)) + "SELECT *, " + ", ".join(
    f"CAST(datediff('day', {p}_start_date, {p}_end_date) AS INTEGER) AS {p}_duration" for p in sorted(O.POLICY_OF.values()))
          + " FROM ps")
def q_policy_duration(spark, sf_dir):
    return X.policy_duration(_t(spark, sf_dir), CFG)


@register("policy_exposure", with_(O.GEO, O.sd_cte(CFG), O.ps_cte(CFG), O.pe_cte(CFG)) + "SELECT * FROM pe")
def q_policy_exposure(spark, sf_dir):
    return X.policy_exposure(_t(spark, sf_dir), CFG)


_MC_D = ["orders_increase", "urgent_increase", "order_value", "state_pop_mil", "orders_increase_per_mil",
         "urgent_increase_per_mil",
         "urgent_orders_baseline", "orders_baseline", "urgent_orders_baseline_6_roll_mean",
         "orders_baseline_6_roll_mean", "WSEIC", "CW", "avg_order_value_q", "price_index"]
_MC_O = ["year", "month", "quarter", "state", "state_initial", "date", "state_pop", "wk_num", "IC", "FIC", "XIC", "WSIC"]


@register("master_current", with_(*O.master_current_ctes(CFG)) + O.round_select(_MC_D, _MC_O, "mc"))
def q_master_current(spark, sf_dir):
    return _sel(X.master_current(_t(spark, sf_dir), CFG), _MC_O + _MC_D)


@register("master_projection", with_(*O.master_current_ctes(CFG), O.ps_cte(CFG), O.pe_cte(CFG), """mp AS (
  SELECT pe.* EXCLUDE (month), mc.* EXCLUDE (state, state_initial, date, year, quarter, month, avg_order_value_q),
         q.avg_order_value_q
  FROM pe
  LEFT JOIN mc ON mc.state = pe.state AND mc.state_initial = pe.state_initial AND mc.date = pe.date
  LEFT JOIN q ON q.year = pe.year AND q.quarter = pe.quarter
)""") + "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in _MC_D) + ") FROM mp")
def q_master_projection(spark, sf_dir):
    return round_doubles(X.master_projection(_t(spark, sf_dir), CFG))


@register("scenario_merge", with_(O.GEO, O.sd_cte(CFG, "cur"), O.sd_cte(CFG, "bes", "F"), O.sd_cte(CFG, "wor", "O")) + """
SELECT c.state, c.date, c.state_initial, c.n_orders, round(c.order_value, 4) AS order_value,
       b.n_orders AS n_orders_bes, round(b.order_value, 4) AS order_value_bes,
       w.n_orders AS n_orders_wor, round(w.order_value, 4) AS order_value_wor
FROM cur c
LEFT JOIN bes b ON b.state = c.state AND b.date = c.date AND b.state_initial = c.state_initial
LEFT JOIN wor w ON w.state = c.state AND w.date = c.date AND w.state_initial = c.state_initial""")
def q_scenario_merge(spark, sf_dir):
    return round_doubles(X.scenario_merge(_t(spark, sf_dir), CFG))


@register("flatten_series_json", """
SELECT event_id, event_type, round(value, 4) AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL""")
def q_flatten_series_json(spark, sf_dir):
    return round_doubles(X.flatten_props(_t(spark, sf_dir), CFG))


@register("geo_filtered_codes", with_(O.GEO) + f"""
SELECT g.state, g.state_initial, o.o_orderpriority AS priority, count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.location_id
WHERE o.o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY ALL""")
def q_geo_filtered_codes(spark, sf_dir):
    return X.geo_filtered_codes(_t(spark, sf_dir), CFG)


@register("wide_to_long_quarters", """
SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year,
       'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, round(avg(o_totalprice), 4) AS avg_value
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def q_wide_to_long_quarters(spark, sf_dir):
    return round_doubles(X.wide_to_long_quarters(_t(spark, sf_dir), CFG))


@register("claims_renamed", with_(O.GEO, O.sd_cte(CFG), O.CLAIMS) + O.round_select(
    ["WSEIC", "CW"], ["state_initial", "wk_num", "IC", "FIC", "XIC", "WSIC", "date", "state"], "cr"))
def q_claims_renamed(spark, sf_dir):
    return round_doubles(X.claims_renamed(_t(spark, sf_dir), CFG))


@register("price_index_clean", with_(O.PRICE) + "SELECT year, period, latest, round(value, 4) AS value, month FROM pr")
def q_price_index_clean(spark, sf_dir):
    return round_doubles(X.price_index_clean(_t(spark, sf_dir), CFG))


@register("ship_actuals_dated", with_(*_SHIP, O.ship_actuals_dated_cte(CFG)) + O.round_select(
    ["qty", "dollars", "stly_qty", "stly_dollars"], ["sell_id", "state", "category", "week_of_year", "week_ending_date"],
    "sad"))
def q_ship_actuals_dated(spark, sf_dir):
    return round_doubles(RP.ship_actuals_dated(_t(spark, sf_dir), CFG))


_SST_D = ["qty", "dollars", "forecast_quantity", "promo_uplift", "ly_qty", "ly_dollars"]
_SST_O = ["sell_id", "state", "category", "week_ending_date"]


@register("ship_actual_forecast_stitch", with_(*_SHIP_ALL, O.corrections_cte(CFG, DEFAULT_CORRECTIONS), _RT,
                                               *O.ship_stitch_ctes(CFG)) + O.round_select(_SST_D, _SST_O, "sst"))
def q_ship_actual_forecast_stitch(spark, sf_dir):
    return _sel(RP.ship_actual_forecast_stitch(_t(spark, sf_dir), CFG), _SST_O + _SST_D)


@register("seasonal_fit_grouped", with_(FACT, O.model_weekly_cte(CFG), *O.fourier_ctes(CFG))
          + O.round_select(["seasonal_forecast"], ["sell_id", "week_ending_date"], "ff"))
def q_seasonal_fit_grouped(spark, sf_dir):
    return round_doubles(FC.seasonal_fit_grouped(_t(spark, sf_dir), CFG))


from demandlab.sources.literals import DEFAULT_ACCOUNT_RULES  # noqa: E402

_AC_O = ["retailer", "state", "channel", "category", "week_ending_date", "hold_last_rule", "scale_rule", "set_ly_rule",
         "close_gap_rule", "cumulative_rule"]


@register("account_corrections", with_(FACT, O.weekly_cte("w", channel=True), O.ms_cte(CFG), *O.account_ctes(CFG, DEFAULT_ACCOUNT_RULES))
          + O.round_select(["qty_ly", "forecast_quantity"], _AC_O, "ac"))
def q_account_corrections(spark, sf_dir):
    from demandlab.plans.accounts import account_corrections
    return round_doubles(account_corrections(_t(spark, sf_dir), CFG))


_PFM_D = ["qty_ty", "dollars_ty", "qty_ly", "dollars_ly", "marker_first", "marker_second", "marker_third"]
_PFM_O = ["sell_id", "state", "category", "week_of_year", "week_ending_date"]


@register("pos_fact_with_markers", with_(*_POS, O.PFM) + O.round_select(_PFM_D, _PFM_O, "pfm"))
def q_pos_fact_with_markers(spark, sf_dir):
    return _sel(RP.pos_fact_with_markers(_t(spark, sf_dir), CFG), _PFM_O + _PFM_D)


@register("latest_file_read", """
SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM events""")
def q_latest_file_read(spark, sf_dir):
    """Newest drop of a folder: an older drop of half of the events with other
    values, then one of all events; each is a folder of files written in parallel."""
    import time

    from demandlab.sources.files import latest_file_read
    drop = _scratch(spark, "drop")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1000).write.parquet(f"{drop}/first")
    time.sleep(0.05)  # drops are told apart by modification time
    events.write.parquet(f"{drop}/second")
    return round_doubles(latest_file_read(spark, drop, "parquet", pattern="*.parquet"))


@register("series_response", f"""
SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INTEGER) AS year, 'M' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS period,
       CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice), 2) AS value
FROM orders WHERE o_orderpriority NOT IN ('{X.PRIORITIES[4]}', '{X.PRIORITIES[3]}') GROUP BY ALL""")
def q_series_response(spark, sf_dir):
    return X.series_points(_t(spark, sf_dir), CFG)


@register("two_row_header_quarters", """
SELECT o_orderpriority AS priority, 'level' AS unit, CAST(year(o_orderdate) AS INTEGER) AS year,
       'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, round(avg(o_totalprice), 4) AS avg_value
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def q_two_row_header_quarters(spark, sf_dir):
    from demandlab.sources.files import newest_drop, read_two_row_header
    folder = _scratch(spark, "quarters")
    X.land_two_row_header(_t(spark, sf_dir), f"{folder}/drop1", CFG)
    return round_doubles(read_two_row_header(spark, newest_drop(spark, folder, "*.txt"), 2, "avg_value"))


_EXCLUDED = ", ".join(f"('{s}', '{c}')" for s, c in CFG.excluded_series)


@register("ship_coverage", with_(*_SHIP) + f"""
, model AS (
  SELECT DISTINCT l.sell_id, CASE WHEN l.status = 'complete' THEN 1 ELSE 0 END AS common_product
  FROM lifespan l WHERE l.state IS NOT NULL AND (l.state, l.category) NOT IN ({_EXCLUDED})),
cov AS (
  SELECT coalesce(m.qty, 0.0) AS qty,
         CASE WHEN m.sell_id IS NULL THEN 'model_only' WHEN l.common_product = 1 THEN 'common'
              WHEN l.common_product = 0 THEN 'non_common' ELSE 'not_modeled' END AS coverage
  FROM (SELECT sell_id, sum(qty) AS qty FROM mw GROUP BY sell_id) m
  FULL OUTER JOIN model l ON l.sell_id = m.sell_id
),
per AS (SELECT coverage, count(*) AS n_series, sum(qty) AS qty FROM cov GROUP BY coverage)
SELECT coverage, CAST(n_series AS BIGINT) AS n_series, round(qty, 4) AS qty,
       round(100.0 * n_series / sum(n_series) OVER (), 4) AS pct_series,
       round(100.0 * qty / nullif(sum(qty) OVER (), 0), 4) AS pct_qty
FROM per""")
def q_ship_coverage(spark, sf_dir):
    return RP.ship_coverage(_t(spark, sf_dir), CFG)


# ------------------------------------------------------------- ledger as landed ----

from demandlab.plans import ledger as LG  # noqa: E402

_LEDGER = f"""landed AS (
  SELECT CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS material,
         'C' || CAST(l_suppkey % 7 AS VARCHAR) AS account, l_linestatus AS version,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS bill_date, CAST(l_shipdate AS DATE) AS created,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice END AS value, l_quantity AS qty, l_returnflag AS channel,
         CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS period
  FROM lineitem)"""
_BILLED = (f"coalesce(bill_date, created) BETWEEN DATE '{CFG.ly_year}-01-01' AND {d(CFG.latest_week)}")
_PERIODS = ", ".join(str(p) for p in LG.fiscal_periods(CFG))
_LINES = f"""lines AS (
  SELECT *, lpad(material, 10, '0') AS material_id FROM landed
  WHERE material <> '' AND version = 'F' AND {_BILLED} AND account <> 'C3' AND value <> 0 AND period IN ({_PERIODS}))"""
_HIERARCHY = """hs AS (
  SELECT l.period, l.channel, h.category, h.management_group, count(*) AS n_lines, sum(qty) AS qty, sum(value) AS value
  FROM lines l LEFT JOIN (
    SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS material_id, l_returnflag AS channel, p_type AS category,
           CASE WHEN p_size <> 1 THEN p_brand END AS management_group
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 5 <> 0) h USING (material_id, channel)
  GROUP BY ALL)"""


@register("ledger_filtered", with_(_LEDGER, _LINES) + """
SELECT period, channel, material_id, count(*) AS n_lines, round(sum(qty), 4) AS qty, round(sum(value), 4) AS value
FROM lines GROUP BY ALL""")
def q_ledger_filtered(spark, sf_dir):
    return round_doubles(LG.ledger_filtered(_t(spark, sf_dir), CFG))


@register("ledger_filter_loss", with_(_LEDGER) + f"""
SELECT 'material' AS rule, count(*) AS n_removed FROM landed WHERE NOT coalesce(material <> '', false)
UNION ALL SELECT 'version', count(*) FROM landed WHERE NOT coalesce(version = 'F', false)
UNION ALL SELECT 'bill_date', count(*) FROM landed WHERE NOT coalesce({_BILLED}, false)
UNION ALL SELECT 'account', count(*) FROM landed WHERE NOT coalesce(account <> 'C3', false)
UNION ALL SELECT 'value', count(*) FROM landed WHERE NOT coalesce(value <> 0, false)
UNION ALL SELECT 'period', count(*) FROM landed WHERE NOT coalesce(period IN ({_PERIODS}), false)""")
def q_ledger_filter_loss(spark, sf_dir):
    return LG.ledger_filter_loss(_t(spark, sf_dir), CFG)


@register("hierarchy_sales", with_(_LEDGER, _LINES, _HIERARCHY) + """
SELECT period, channel, category, management_group, n_lines, round(qty, 4) AS qty, round(value, 4) AS value FROM hs""")
def q_hierarchy_sales(spark, sf_dir):
    return round_doubles(LG.hierarchy_sales(_t(spark, sf_dir), CFG))


@register("managed_sales", with_(_LEDGER, _LINES, _HIERARCHY) + f"""
SELECT management_group, CAST(sum(n_lines) AS BIGINT) AS n_lines, round(sum(qty), 4) AS qty, round(sum(value), 4) AS value
FROM hs WHERE period // 100 = {CFG.ly_year} AND management_group IS NOT NULL GROUP BY ALL""")
def q_managed_sales(spark, sf_dir):
    return round_doubles(LG.managed_sales(_t(spark, sf_dir), CFG))


@register("null_profile", SQL["yoy_category"].join(["WITH yc AS (", """)
SELECT year, CAST(sum(CASE WHEN stly_qty IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round(avg(CASE WHEN stly_qty IS NULL THEN 1.0 ELSE 0.0 END), 4) AS stly_qty_null_share
FROM yc GROUP BY year"""]))
def q_null_profile(spark, sf_dir):
    from demandlab.functions.scalar import null_flag
    from demandlab.operators.quality import null_share
    y = series.yoy_category(_t(spark, sf_dir), CFG)
    return round_doubles(y.groupBy("year").agg(F.sum(null_flag("stly_qty")).alias("n_null"), null_share("stly_qty")))


@register("date_parts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       CAST(isodow(o_orderdate) % 7 + 1 AS INTEGER) AS dayofweek, count(*) AS n_orders FROM orders GROUP BY ALL""")
def q_date_parts(spark, sf_dir):
    from demandlab.functions.dates import with_date_part
    o = _t(spark, sf_dir).orders.select("o_orderdate")
    for part in ("year", "quarter"):
        o = with_date_part(o, "o_orderdate", part)
    o = with_date_part(o, "o_orderdate", "dayofweek", drop_source=True)
    return o.groupBy("year", "quarter", "dayofweek").agg(F.count(F.lit(1)).alias("n_orders"))


# ---------------------------------------------------------- landed external data ----

_BASELINES = ["retail_and_recreation", "grocery_and_pharmacy", "parks", "transit_stations", "workplaces", "residential"]
_BASELINES = [f"{b}_percent_change_from_baseline" for b in _BASELINES]
_LM_M = ", ".join(f"CAST({'n_orders' if i % 2 == 0 else 'urgent_orders'} AS DOUBLE) AS {b}" for i, b in enumerate(_BASELINES))
_LM_R = ", ".join(f"CASE WHEN count({b}) OVER w6 >= 6 THEN round(avg({b}) OVER w6, 4) END AS {b}_6_roll_mean" for b in _BASELINES)


@register("landed_master", with_(O.GEO, O.sd_cte(CFG), O.CLAIMS, O.QUARTERLY, O.PRICE, f"m AS (SELECT state, state_initial, date, n_orders, urgent_orders, {_LM_M} FROM sd)",
                                 f"r AS (SELECT *, {_LM_R} FROM m WINDOW w6 AS (PARTITION BY state ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))") + f"""
SELECT r.state, r.state_initial, r.date, CAST(year(r.date) AS INTEGER) AS year, 'q' || CAST(quarter(r.date) AS VARCHAR) AS quarter,
       CAST(month(r.date) AS INTEGER) AS month, r.n_orders AS src2_cases, CAST(r.urgent_orders AS BIGINT) AS src2_deaths,
       {", ".join(_BASELINES)}, {", ".join(b + "_6_roll_mean" for b in _BASELINES)},
       cr.IC, round(q.avg_order_value_q, 4) AS unemployment_rate, round(pr.value, 4) AS price_index
FROM r LEFT JOIN cr ON cr.state = r.state AND cr.date = r.date
LEFT JOIN q ON q.year = year(r.date) AND q.quarter = 'q' || CAST(quarter(r.date) AS VARCHAR)
LEFT JOIN pr ON pr.year = year(r.date) AND pr.month = month(r.date)""")
def q_landed_master(spark, sf_dir):
    from demandlab.plans import landed
    t, folder = _t(spark, sf_dir), _scratch(spark, "landed")
    landed.land_drops(t, folder, CFG)
    return round_doubles(landed.landed_master(t, folder, CFG))


@register("merge_metrics", with_(O.GEO, O.sd_cte(CFG), O.CLAIMS, O.QUARTERLY, O.PRICE) + """
, n AS (SELECT count(*) AS n FROM sd)
SELECT 'mobility' AS merge, n AS rows_left, n AS rows_right, n AS rows_out, n AS rows_met FROM n
UNION ALL SELECT 'claims', n, (SELECT count(*) FROM cr), n, (SELECT count(*) FROM sd JOIN cr USING (state, state_initial, date)) FROM n
UNION ALL SELECT 'quarterly', n, (SELECT count(*) FROM q WHERE year IS NOT NULL), n,
  (SELECT count(*) FROM sd JOIN q ON q.year = year(sd.date) AND q.quarter = 'q' || CAST(quarter(sd.date) AS VARCHAR)) FROM n
UNION ALL SELECT 'prices', n, (SELECT count(*) FROM pr WHERE year IS NOT NULL), n,
  (SELECT count(*) FROM sd JOIN pr ON pr.year = year(sd.date) AND pr.month = month(sd.date)) FROM n""")
def q_merge_metrics(spark, sf_dir):
    from demandlab.plans import landed
    t, folder = _t(spark, sf_dir), _scratch(spark, "landed")
    landed.land_drops(t, folder, CFG)
    return landed.merge_metrics(t, folder, CFG)


# ------------------------------------------------- refresh, read back, quality ----

@register("refreshed_sales", with_(FACT, O.model_weekly_cte(CFG)) + f"""
SELECT sell_id, state, category, round(qty, 4) AS qty, round(dollars, 4) AS dollars, week_ending_date FROM mw WHERE year = {CFG.ty_year}""")
def q_refreshed_sales(spark, sf_dir):
    from demandlab.plans import refresh
    return round_doubles(refresh.refreshed_sales(_t(spark, sf_dir), _scratch(spark, "refresh"), CFG))


@register("merged_shards", with_(*_POS, O.naive_pos_cte(CFG), *O.fourier_ctes(CFG)) + """
SELECT 'naive' AS model, sell_id, state, category, week_ending_date, round(forecast_quantity, 4) AS forecast_quantity,
       CAST(NULL AS DOUBLE) AS seasonal_forecast, round(pos_actuals_avg, 4) AS pos_actuals_avg FROM np
UNION ALL
SELECT 'seasonal', sell_id, NULL, NULL, week_ending_date, NULL, round(seasonal_forecast, 4), NULL FROM ff""")
def q_merged_shards(spark, sf_dir):
    from demandlab.plans import refresh
    return round_doubles(refresh.merged_shards(_t(spark, sf_dir), _scratch(spark, "shards"), CFG))


_SHOWN = "concat_ws('|', coalesce(state, '?'), coalesce(state_initial, '?'), coalesce(CAST(date AS VARCHAR), '?'))"
_ROW_CHECKS = [
    ("state is not null", "state IS NOT NULL"), ("order_value is not null", "order_value IS NOT NULL"),
    (f"n_orders in 0..{10 ** 12}", f"n_orders IS NULL OR n_orders BETWEEN 0 AND {10 ** 12}"),
    ("state_initial matches ^[A-Z]{2}$", "state_initial IS NULL OR regexp_full_match(state_initial, '[A-Z][A-Z]')"),
    ("state_initial is a known value", "state_initial IS NULL OR (state_initial >= 'AA' AND state_initial <= 'AY' AND length(state_initial) = 2)"),
    ("a value needs orders", "n_orders > 0 OR order_value IS NULL")]
_TABLE_CHECKS = [
    ("25 values of state", "count(DISTINCT state) = 25"), ("50 values of state", "count(DISTINCT state) = 50"),
    ("date within 30 days", f"datediff('day', max(date), {d(CFG.projection_to)}) BETWEEN 0 AND 30"),
    ("date within 7 days", f"datediff('day', max(date), {d(CFG.as_of)}) BETWEEN 0 AND 7"),
    ("at least 100 rows", "count(*) >= 100")]


@register("quality_report", with_(O.GEO, O.sd_cte(CFG)) + """
, bad AS (
  SELECT CASE WHEN day(date) = 13 AND month(date) = 1 THEN NULL ELSE state END AS state,
         CASE WHEN day(date) = 14 AND month(date) = 2 THEN '??' ELSE state_initial END AS state_initial, date,
         CASE WHEN day(date) = 15 AND month(date) = 3 THEN -n_orders ELSE n_orders END AS n_orders,
         CASE WHEN day(date) = 16 AND month(date) = 4 THEN NULL ELSE order_value END AS order_value FROM sd),
dirty AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE day(date) = 17 AND month(date) = 5),
checks AS (""" + " UNION ALL ".join(
    [f"SELECT '{n}' AS name, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS violations, "
     f"min({_SHOWN}) FILTER (WHERE NOT coalesce({c}, false)) AS example FROM dirty" for n, c in _ROW_CHECKS]
    + [f"SELECT '{n}', CASE WHEN {c} THEN 0 ELSE 1 END, NULL FROM dirty" for n, c in _TABLE_CHECKS]
    + [f"SELECT '{k} is unique', coalesce(sum(n - 1), 0), min(x) FROM (SELECT {k}, count(*) AS n, concat_ws('|', {x}) AS x FROM dirty GROUP BY {k}) y WHERE n > 1"
       for k, x in (("state, state_initial, date", "coalesce(state, '?'), coalesce(state_initial, '?'), coalesce(CAST(date AS VARCHAR), '?')"),
                    ("state_initial, date", "coalesce(state_initial, '?'), coalesce(CAST(date AS VARCHAR), '?')"))]
    + ["SELECT 'columns', 2, 'n_orders'"]) + """)
SELECT name AS "check", violations = 0 AS passed, CAST(violations AS BIGINT) AS violations, example FROM checks""")
def q_quality_report(spark, sf_dir):
    from demandlab.operators.expectations import report
    from demandlab.plans import refresh
    df = refresh.dirty_daily(_t(spark, sf_dir), CFG)
    contract = ["state", "state_initial", "date", "orders", "order_value"]
    return report(df, refresh.daily_checks(CFG), ["state", "state_initial", "date"], contract)


@register("case_master", with_(O.GEO, O.sd_cte(CFG)) + f"""
, wc AS (SELECT state_initial, {wk('date')} AS date, CAST(sum(n_orders) AS BIGINT) AS weekly_claims FROM sd GROUP BY ALL)
SELECT s.state, s.state_initial, s.date, CAST(n_orders AS DOUBLE) AS deaths_mean, CAST(urgent_orders AS DOUBLE) AS new_pop_affected,
       n_orders AS "positiveIncrease", urgent_orders AS "deathIncrease", weekly_claims,
       CAST(datediff('day', (SELECT max(date) FROM sd), {d(CFG.projection_to)}) AS INTEGER) AS lag_days,
       (SELECT count(DISTINCT state) FROM sd) AS n_states
FROM sd s LEFT JOIN wc USING (state_initial, date)""")
def q_case_master(spark, sf_dir):
    from demandlab.plans import landed_cases
    t, folder = _t(spark, sf_dir), _scratch(spark, "cases")
    landed_cases.land_case_drops(t, folder, CFG)
    return landed_cases.case_master(t, folder, CFG)


@register("series_of_catalog", with_(FACT, O.model_weekly_cte(CFG)) + """
SELECT sell_id, split_part(sell_id, '_', 1) AS category, split_part(sell_id, '_', 2) AS state, round(sum(qty), 4) AS qty, count(*) AS weeks
FROM mw GROUP BY sell_id""")
def q_series_of_catalog(spark, sf_dir):
    from demandlab.plans import landed_cases
    return round_doubles(landed_cases.series_of_catalog(_t(spark, sf_dir), CFG))
