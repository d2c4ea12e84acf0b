"""Milestone dates from the projection series.

The projections (driver analog: orders per state and day of the projection
window) give every state its peak day and the first later day below a share of
the peak; the country's peak day is the first milestone of all states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.operators.joins import attach_scalars
from demandlab.plans.external import geography, state_orders
from demandlab.session import shared
from demandlab.sources.tables import Tables


def projection_series(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """(state, date, value) of the projection window; a day without a row is 0 to
    the readers below.  The geography side is the 25-row nation table: broadcast."""
    region = F.broadcast(geography(t).select("state", F.col("country").alias("region")))
    return (state_orders(t).where(F.col("date").between(F.lit(cfg.projection_from), F.lit(cfg.projection_to)))
            .join(region, "state").groupBy(F.col("region").alias("state"), "date").agg(F.sum("n").alias("value")))


def peak_and_fall(series: DataFrame, keys: list[str], cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per key: peak_value, peak_day (the first of equal ones), fall_day (the
    first day after the peak below ``cfg.fall_share`` of it) and crossed.

    One ordered aggregation: a key's days, at most as many as the window has,
    are gathered once and read in order.  A series that doesn't fall below the
    share by the end of the window has its last day as fall_day, not crossed.
    """
    days = F.sequence(F.lit(cfg.projection_from), F.lit(cfg.projection_to))
    value = F.map_from_entries(F.collect_list(F.struct("date", "value")))
    rows = series.where("date IS NOT NULL").groupBy(*keys).agg(value.alias("known")).select(
        *keys, F.transform(days, lambda d: F.struct(d.alias("day"), F.coalesce(F.element_at("known", d), F.lit(0)).alias("value"))).alias("days"))
    top = F.array_max(F.transform("days", lambda x: F.struct(x["value"].alias("value"), (-F.unix_date(x["day"])).alias("early"))))
    rows = rows.withColumn("top", top).select(
        *keys, "days", F.col("top.value").alias("peak_value"), F.date_from_unix_date(-F.col("top.early")).alias("peak_day"))
    low = F.filter("days", lambda x: (x["day"] > F.col("peak_day")) & (x["value"] < F.lit(cfg.fall_share) * F.col("peak_value")))
    return rows.withColumn("low", low).select(
        *keys, "peak_day", "peak_value",
        F.when(F.size("low") > 0, F.col("low")[0]["day"]).otherwise(F.lit(cfg.projection_to)).alias("fall_day"),
        (F.size("low") > 0).alias("crossed"))


def projection_milestones(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """(state, peak_day, peak_value, fall_day, crossed, national_peak_day): a row
    per state of the projections.  A stage: written once a run."""
    def build():
        s = projection_series(t, cfg)
        country = s.groupBy("date").agg(F.sum("value").alias("value"))
        national = (peak_and_fall(country.withColumn("country", F.lit("all")), ["country"], cfg)
                    .agg(F.max("peak_day").alias("national_peak_day")))
        return attach_scalars(peak_and_fall(s, ["state"], cfg), national)
    return shared(t, ("projection_milestones", cfg), build)
