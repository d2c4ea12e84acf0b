"""A warehouse table that is refreshed week by week, and stages read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.operators.expectations import Check, at_least_rows, between, distinct_values, fresh, holds, matches, not_null, one_of, unique
from demandlab.plans.external import state_daily
from demandlab.plans.forecast import naive_rate_of_sale, seasonal_fit_grouped
from demandlab.plans.series import model_weekly
from demandlab.sources.files import refresh_partitions, write_column_contract, read_column_contract, write_stage
from demandlab.sources.external import land_source, read_shards
from demandlab.sources.tables import Tables

REFRESHED_WEEKS = 4  # weeks before the latest one that a refresh delivers anew


def refreshed_sales(t: Tables, root: str, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """The weekly sales table after a refresh, read back from ``root``.

    The first load holds this year's weeks up to a week before L; its last weeks
    are preliminary (quantities halved, one category missing).  The refresh
    replaces the partitions of the weeks that it delivers, whole, and adds the
    latest week; other partitions aren't touched.
    """
    w = model_weekly(t, cfg).where(F.col("year") == cfg.ty_year).select("sell_id", "state", "category", "qty", "dollars", "week_ending_date")
    latest, week = F.lit(cfg.latest_week), F.col("week_ending_date")
    late = (week >= F.date_sub(latest, 7 * REFRESHED_WEEKS))
    first = w.where((week < latest) & (~late | ~F.col("category").eqNullSafe(F.lit("SMALL")))).withColumn(
        "qty", F.when(late, F.col("qty") / 2).otherwise(F.col("qty")))
    path = f"{root}/sales"
    refresh_partitions(first, path, ["week_ending_date"])
    write_column_contract(t.spark, first, f"{root}/contract")
    refresh_partitions(w.where(late), path, ["week_ending_date"], expected=read_column_contract(t.spark, f"{root}/contract"))
    return t.spark.read.schema(w.schema).parquet(path).select(*w.columns)


def merged_shards(t: Tables, root: str, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Model outputs with differing columns, each landed as a shard of one
    folder without its internal columns, and read back as one table; a column
    that a shard lacks is NULL there."""
    naive = naive_rate_of_sale(t, cfg).select("sell_id", "state", "category", "week_ending_date", "forecast_quantity", "pos_actuals_avg", "week_of_year")
    seasonal = seasonal_fit_grouped(t, cfg).withColumn("internal", F.lit(1))
    land_source(naive.withColumn("model", F.lit("naive")), f"{root}/shards/naive", drop=("week_of_year", "not there"))
    land_source(seasonal.withColumn("model", F.lit("seasonal")), f"{root}/shards/seasonal", drop=("internal",))
    write_stage(seasonal.limit(0).withColumn("model", F.lit("none")).drop("internal"), f"{root}/shards", "none")
    return read_shards(t.spark, f"{root}/shards", merge=True).select(
        "model", "sell_id", "state", "category", "week_ending_date", "forecast_quantity", "seasonal_forecast", "pos_actuals_avg")


# ---------------------------------------------------------------- quality ----

def dirty_daily(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """The daily state series as a careless delivery: blanked states, a doubled
    day a month, negative values, an unknown code."""
    d = state_daily(t, cfg).select("state", "state_initial", "date", F.col("n_orders").cast("long").alias("n_orders"), "order_value")
    day, month = F.dayofmonth("date"), F.month("date")
    bad = d.select(
        F.when((day == 13) & (month == 1), F.lit(None)).otherwise(F.col("state")).alias("state"),
        F.when((day == 14) & (month == 2), F.lit("??")).otherwise(F.col("state_initial")).alias("state_initial"), "date",
        F.when((day == 15) & (month == 3), -F.col("n_orders")).otherwise(F.col("n_orders")).alias("n_orders"),
        F.when((day == 16) & (month == 4), F.lit(None)).otherwise(F.col("order_value")).alias("order_value"))
    return bad.unionByName(bad.where((day == 17) & (month == 5)))


def daily_checks(cfg: ModelConfig = DEFAULT_CONFIG) -> list[Check]:
    """What the daily state series must hold."""
    return [not_null("state"), not_null("order_value"), between("n_orders", 0, 10 ** 12), matches("state_initial", "^[A-Z]{2}$"),
            one_of("state_initial", [f"A{chr(65 + i)}" for i in range(25)]),
            holds("a value needs orders", (F.col("n_orders") > 0) | F.col("order_value").isNull()),
            distinct_values("state", 25), distinct_values("state", 50), fresh("date", cfg.projection_to, 30), fresh("date", cfg.as_of, 7),
            at_least_rows(100), unique("state", "state_initial", "date"), unique("state_initial", "date")]
