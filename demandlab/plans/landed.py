"""The external-data chain from landed files to a merged master.

``land_drops`` writes the given tables' analogs as CSV drops, as a download
would leave them: an older drop and a newer one of each source, county rows
beside state rows, coded claims columns as text.  ``landed_master`` is what a
run does with such folders: newest file, header-checked schema, preprocessors,
features, checked merges.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlab.config import DEFAULT_CONFIG, ModelConfig
from demandlab.functions.dates import month_number, with_date_meta
from demandlab.operators.joins import ObservedJoins
from demandlab.operators.quality import assert_column_contract, assert_no_overlap
from demandlab.operators.reshape import columns_with, drop_tolerant, rename
from demandlab.operators.windows import rolling_many
from demandlab.plans import external
from demandlab.sources import external as readers
from demandlab.sources.tables import Tables

SOURCES = ("mobility", "cases", "claims", "quarterly", "prices")


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]


def land_drops(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> None:
    """One folder per source below ``folder``, each with an older drop (half of
    the rows, other values) and a newer one; a drop is a folder of CSV files."""
    d = external.state_daily(t, cfg)
    measures = dict(zip([c for c in _names(readers.MOBILITY_SCHEMA) if c.endswith("baseline")],
                        ("n_orders", "urgent_orders", "n_orders", "urgent_orders", "n_orders", "urgent_orders")))
    head = [F.lit("US").alias("country_region_code"), F.lit("United States").alias("country_region"), F.col("state").alias("sub_region_1")]
    values = [F.col(m).cast("double").alias(c) for c, m in measures.items()]
    none = F.lit(None).cast("string")
    state = d.select(*head, none.alias("sub_region_2"), none.alias("census_fips_code"), "date", *values)
    county = d.select(*head, F.lit("Some County").alias("sub_region_2"), F.lit("1").alias("census_fips_code"), "date", *values)
    claims = external.claims_raw(t, cfg)
    claims = claims.withColumns({c: none for c in _names(readers.CLAIMS_SCHEMA) if c not in claims.columns})
    frames = {
        "mobility": state.unionByName(county),
        "cases": d.select("date", "state", F.col("n_orders").cast("long").alias("cases"), F.col("urgent_orders").cast("long").alias("deaths")),
        "claims": claims.select(*_names(readers.CLAIMS_SCHEMA)),
        "quarterly": external.quarterly_series(t, cfg).filter(F.col("year").isNotNull()).withColumnRenamed("avg_order_value_q", "unemployment_rate"),
        "prices": external.price_index_raw(t, cfg).filter(F.col("year").isNotNull()).select(*_names(readers.PRICE_SCHEMA)),
    }
    for name in SOURCES:  # the older drop: half of the rows, with other values
        f = frames[name]
        other = {c.name: F.col(c.name) + 1000 for c in f.schema if c.dataType.typeName() in ("long", "double")}
        f.where(F.pmod(F.xxhash64(*f.columns), F.lit(2)) == 0).withColumns(other).write.option("header", "true").csv(f"{folder}/{name}/drop1")
    time.sleep(0.05)  # drops are told apart by modification time
    for name in SOURCES:
        frames[name].write.option("header", "true").csv(f"{folder}/{name}/drop2")


def read_drops(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The newest file of each source with its schema."""
    return {"mobility": readers.read_mobility(spark, f"{folder}/mobility"),
            "cases": readers.read_second_case_source(spark, f"{folder}/cases"),
            "claims": readers.read_weekly_claims(spark, f"{folder}/claims"),
            "quarterly": readers.read_quarterly_unemployment(spark, f"{folder}/quarterly"),
            "prices": readers.read_price_index(spark, f"{folder}/prices")}


def merge_drops(drops: dict[str, DataFrame], geo: DataFrame, checks: ObservedJoins, k: int = 6) -> DataFrame:
    """Preprocess every source and merge it into one row per state and day.
    Each merge checks that the sides share no other column than the keys, and
    ``checks`` observes that the right side's keys are unique; the result's
    columns are a contract."""
    keys = ["state", "state_initial", "date"]
    cases = external.basic_preproc(drops["cases"], geo, "state")
    mobility = external.mobility_preproc(drops["mobility"])
    mobility = external.basic_preproc(mobility, geo, "sub_region_1", "country_region", "United States",
                                      drop=("country_region_code",)).drop("country_region")
    mobility = rolling_many(mobility, ["state"], "date", columns_with(mobility, "baseline"), k, "mean")
    claims = rename(drops["claims"], external.CLAIMS_CODES)
    claims = claims.withColumn("date", F.try_to_date(F.col("refl_wk_date"), "M/d/yyyy")).withColumnRenamed("st", "state_initial")
    claims = drop_tolerant(claims, external.CLAIMS_DROP).select("state_initial", "date", F.col("IC").cast("long").alias("IC"))
    claims = claims.join(F.broadcast(geo.select("state", "state_initial")), "state_initial", "inner")
    prices = drops["prices"].select(F.col("year").cast("int").alias("year"), month_number("periodName").alias("month"),
                                    F.col("value").cast("double").alias("price_index"))
    out = with_date_meta(cases, "date")
    for name, right, on, how in (("mobility", mobility, keys, "1:1"), ("claims", claims, keys, "1:1"),
                                 ("quarterly", drops["quarterly"], ["year", "quarter"], "m:1"), ("prices", prices, ["year", "month"], "m:1")):
        assert_no_overlap(out, right, on)
        out = checks.join(name, out, right, on, how)
    assert_column_contract(out, [*keys, "year", "quarter", "month", "src2_cases", "src2_deaths", *columns_with(mobility, "baseline"),
                                 "IC", "unemployment_rate", "price_index"])
    return out


def landed_stage(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> tuple[DataFrame, ObservedJoins]:
    """The merged master, written as a stage of the run, and its verified checks."""
    checks = ObservedJoins()
    out = t.run.table(("landed_master", folder, checks), lambda: merge_drops(read_drops(t.spark, folder), external.geography(t), checks))
    checks.verify()
    return out, checks


def landed_master(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    return landed_stage(t, folder, cfg)[0]


def merge_metrics(t: Tables, folder: str, cfg: ModelConfig = DEFAULT_CONFIG) -> DataFrame:
    """What the merges of the landed sources observed while the master was written."""
    return landed_stage(t, folder, cfg)[1].metrics(t.spark)
