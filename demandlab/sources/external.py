"""Typed readers for the landed external sources.

Every source lands as CSV files in its own directory; a refresh adds a new
file.  Each reader reads the newest file of the directory (``latest_file_read``)
with an explicit schema, so no inference pass runs over the data; a header that
differs from the schema, or a value that doesn't parse, fails the read.
Network download is outside the engine: ingestion starts at landed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlab.sources.files import latest_file_read, newest_drop, read_csv

# Column names and types of the landed files.
PROJECTION_SCHEMA = ("location_name string, location_id int, date date, deaths_mean double, "
                     "deaths_lower double, deaths_upper double, new_pop_affected double")
SUMMARY_SCHEMA = ("location_name string, location_id int, peak_bed_day_mean date, "
                  "travel_limit_start_date date, travel_limit_end_date date, "
                  "stay_home_start_date date, stay_home_end_date date, "
                  "educational_fac_start_date date, educational_fac_end_date date, "
                  "any_gathering_restrict_start_date date, any_gathering_restrict_end_date date, "
                  "any_business_start_date date, any_business_end_date date, "
                  "`all_non-ess_business_start_date` date, `all_non-ess_business_end_date` date")
MOBILITY_SCHEMA = ("country_region_code string, country_region string, sub_region_1 string, sub_region_2 string, "
                   "census_fips_code string, date date, "
                   "retail_and_recreation_percent_change_from_baseline double, "
                   "grocery_and_pharmacy_percent_change_from_baseline double, "
                   "parks_percent_change_from_baseline double, "
                   "transit_stations_percent_change_from_baseline double, "
                   "workplaces_percent_change_from_baseline double, "
                   "residential_percent_change_from_baseline double")
CASE_SCHEMA = ("date string, state string, positive long, negative long, death long, hospitalizedCurrently long, "
               "positiveIncrease long, negativeIncrease long, deathIncrease long, hospitalizedIncrease long, "
               "totalTestResultsIncrease long, lastUpdateEt string, hash string, total long, dateChecked string, "
               "fips string, checkTimeEt string")
SECOND_CASE_SCHEMA = "date date, state string, cases long, deaths long"
CLAIMS_SCHEMA = "st string, rptdate string, " + ", ".join(f"c{i} string" for i in range(1, 24)) + \
                ", curdate string, priorwk_pub string, priorwk string"
PANDEMIC_CLAIMS_SCHEMA = "st string, rptdate string, " + ", ".join(f"c{i} long" for i in range(1, 29))
QUARTERLY_SCHEMA = "year int, quarter string, unemployment_rate double"
PRICE_SCHEMA = "year string, period string, periodName string, latest string, value string, footnotes string"


def read_projection_table(spark: SparkSession, directory: str, table: str = "projections",
                          schema: str = PROJECTION_SCHEMA) -> DataFrame:
    """A named table inside the newest projection drop: files ``<table>*.csv`` of
    the drop, or the CSV files of its folder ``<table>*``."""
    try:
        return latest_file_read(spark, directory, "csv", schema, pattern=f"{table}*.csv")
    except FileNotFoundError:
        drop = newest_drop(spark, directory, "*.csv")
        return read_csv(spark, f"{drop}/{table}*", schema, pathGlobFilter="*.csv")


def read_mobility(spark: SparkSession, directory: str) -> DataFrame:
    return latest_file_read(spark, directory, "csv", MOBILITY_SCHEMA)


def read_case_tracking(spark: SparkSession, directory: str) -> DataFrame:
    return latest_file_read(spark, directory, "csv", CASE_SCHEMA)


def read_second_case_source(spark: SparkSession, directory: str, prefix: str = "src2") -> DataFrame:
    """Second case source; its measures are prefixed to stay distinct after a merge."""
    df = latest_file_read(spark, directory, "csv", SECOND_CASE_SCHEMA)
    return df.withColumnsRenamed({"cases": f"{prefix}_cases", "deaths": f"{prefix}_deaths"})


def read_weekly_claims(spark: SparkSession, directory: str) -> DataFrame:
    return latest_file_read(spark, directory, "csv", CLAIMS_SCHEMA)


def read_pandemic_claims(spark: SparkSession, directory: str) -> DataFrame:
    df = latest_file_read(spark, directory, "csv", PANDEMIC_CLAIMS_SCHEMA)
    return df.withColumn("rptdate", F.try_to_date("rptdate", "M/d/yyyy"))


def read_quarterly_unemployment(spark: SparkSession, directory: str) -> DataFrame:
    return latest_file_read(spark, directory, "csv", QUARTERLY_SCHEMA)


def read_price_index(spark: SparkSession, directory: str) -> DataFrame:
    return latest_file_read(spark, directory, "csv", PRICE_SCHEMA)


def read_shards(spark: SparkSession, directory: str, fmt: str = "parquet", merge: bool = False) -> DataFrame:
    """All output shards of a stage as one dataset (one multi-file scan).  With
    ``merge``, shards may differ in columns and lie in sub-folders."""
    r = spark.read.format(fmt)
    return (r.option("mergeSchema", "true").option("recursiveFileLookup", "true") if merge else r).load(directory)


def land_source(df: DataFrame, path: str, drop=(), fmt: str = "parquet") -> str:
    """Land a raw source after dropping columns not kept downstream."""
    df.drop(*[c for c in drop if c in df.columns]).write.mode("overwrite").format(fmt).save(path)
    return path
