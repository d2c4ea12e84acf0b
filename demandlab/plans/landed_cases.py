"""Case tracking, projections and pandemic claims from landed files: the other
half of the external chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import week_ending
from demandlab.functions.scalar import key_part
from demandlab.operators.joins import ObservedJoins, attach_scalars
from demandlab.operators.quality import distinct_count
from demandlab.plans import external
from demandlab.plans.landed import _names
from demandlab.plans.series import model_weekly
from demandlab.sources import external as readers
from demandlab.sources.tables import Tables, read_sql, read_table, strip_column_prefix, use_database

HOMONYM = 999  # location id of a place that is named like a state


def land_case_drops(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> None:
    """``cases``, ``projections`` (a drop with two tables) and ``claims`` below
    ``folder``, each a folder of CSV files."""
    d = external.state_daily(t, cfg)
    none = F.lit(None).cast("string")
    fixed = {"hash": "h", "total": "1", "dateChecked": "d", "fips": "1", "checkTimeEt": "t"}
    cases = d.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("state_initial").alias("state"),
                     F.col("n_orders").alias("positiveIncrease"), F.col("urgent_orders").alias("deathIncrease"),
                     F.date_format("date", "yyyy-MM-dd").alias("lastUpdateEt"), *[F.lit(v).alias(c) for c, v in fixed.items()])
    cases = cases.withColumns({c: none for c in _names(readers.CASE_SCHEMA) if c not in cases.columns})
    projection = external.geography(t).select("state", "location_id").join(d, "state").select(
        F.col("state").alias("location_name"), "location_id", "date", F.col("n_orders").cast("double").alias("deaths_mean"),
        F.col("n_orders").cast("double").alias("deaths_lower"), F.col("n_orders").cast("double").alias("deaths_upper"),
        F.col("urgent_orders").cast("double").alias("new_pop_affected"))
    homonym = projection.withColumn("location_id", F.lit(HOMONYM))
    weekly = d.groupBy("state_initial", week_ending("date").alias("week")).agg(F.sum("n_orders").cast("long").alias("c1"), F.sum("urgent_orders").cast("long").alias("c2"))
    claims = weekly.select(F.col("state_initial").alias("st"), F.date_format("week", "M/d/yyyy").alias("rptdate"), "c1", "c2",
                           *[F.lit(None).cast("long").alias(f"c{i}") for i in range(3, 29)])
    for name, df in (("cases/drop1", cases.select(*_names(readers.CASE_SCHEMA))), ("claims/drop1", claims),
                     ("projections/drop1/summary", projection.select("location_name", "location_id")),
                     ("projections/drop1/projections", projection.unionByName(homonym).select(*_names(readers.PROJECTION_SCHEMA)))):
        df.write.option("header", "true").csv(f"{folder}/{name}")


def case_master(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Projections with case tracking and pandemic claims attached, a row per state
    and day, with the cases' lag behind the end of the projections and the number
    of states.  Written as a stage of the run; the merges' checks are observed."""
    geo = external.geography(t)
    projections = external.basic_preproc(readers.read_projection_table(t.spark, f"{folder}/projections"), geo, "location_name",
                                         exclude_location_id=HOMONYM)
    cases, fresh = external.case_tracking_preproc(readers.read_case_tracking(t.spark, f"{folder}/cases"), cfg.projection_to)
    cases = external.basic_preproc(cases, geo, "state").select("state", "state_initial", F.to_date("date").alias("date"), "positiveIncrease", "deathIncrease")
    claims = readers.read_pandemic_claims(t.spark, f"{folder}/claims").select(
        F.col("st").alias("state_initial"), F.col("rptdate").alias("date"), F.col("c1").alias("weekly_claims"))
    checks = ObservedJoins()

    def build():
        out = projections.select("state", "state_initial", F.to_date("date").alias("date"), "deaths_mean", "new_pop_affected")
        out = checks.join("cases", out, cases, ["state", "state_initial", "date"], "1:1")
        return checks.join("claims", out, claims, ["state_initial", "date"], "m:1")

    out = t.run.table(("case_master", folder, checks), build)
    checks.verify()
    return attach_scalars(attach_scalars(out, fresh.select("lag_days")), distinct_count(out, ["state"], "n_states"))


def series_of_catalog(t: Tables, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """Totals per series through the catalog: a SQL text whose column names carry
    a table prefix, and the parts of the series key."""
    view = f"demandlab_weekly_{abs(hash((t.root, t.database, id(t))))}"
    use_database(t.spark, t.database or "default")
    model_weekly(t, cfg).createOrReplaceTempView(view)
    try:
        totals = strip_column_prefix(read_sql(t.spark, f"SELECT sell_id AS `w.sell_id`, sum(qty) AS `w.qty` FROM {view} GROUP BY sell_id"))
        weeks = read_table(t.spark, view).groupBy("sell_id").agg(F.count(F.lit(1)).alias("weeks"))
    finally:
        t.spark.catalog.dropTempView(view)
    return totals.join(weeks, "sell_id").select("sell_id", key_part("sell_id", 0).alias("category"), key_part("sell_id", 1).alias("state"), "qty", "weeks")
