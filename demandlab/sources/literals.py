"""Small literal lookup tables.

Each is bounded by construction (a handful of rows), so broadcasting them is
always safe regardless of the fact table size.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHANNEL_SCHEMA = T.StructType([
    T.StructField("channel", T.StringType(), True),
    T.StructField("channel_desc", T.StringType(), True),
])

# Channel code (return flag + line status) -> description.
CHANNEL_ROWS = [
    ("AF", "Accepted Fulfilled"),
    ("AO", "Accepted Open"),
    ("NF", "Normal Fulfilled"),
    ("NO", "Normal Open"),
    ("RF", "Returned Fulfilled"),
    ("RO", "Returned Open"),
]


def channel_mapping(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(CHANNEL_ROWS, CHANNEL_SCHEMA))


CORRECTION_SCHEMA = T.StructType([
    T.StructField("rule_state", T.StringType(), True),
    T.StructField("rule_category", T.StringType(), True),
    T.StructField("action", T.StringType(), False),
])

# Retailer/product corrections applied after modelling, as data instead of
# hard-coded conditions.  NULL in a key column matches every value.
#   double      forecast x 2 after the latest week          (e-commerce rule)
#   set_ly      forecast := last year's quantity            (returns-only accounts)
#   halve_gap   forecast := forecast - (forecast - ly) / 2
#   cumulative  forecast := running total of the forecast   (cumulative correction)
#   hold_last   hold the latest actual until the 3rd milestone (channel rule)
#   zero        forecast and promo := 0                     (seasonal category)
DEFAULT_CORRECTIONS = [
    ("AMERICA", "PROMO", "double"),
    ("ASIA", "SMALL", "set_ly"),
    ("EUROPE", "LARGE", "halve_gap"),
    ("AFRICA", "MEDIUM", "cumulative"),
    (None, "STANDARD", "hold_last"),
    ("MIDDLE EAST", "ECONOMY", "zero"),
]


def correction_rules(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else DEFAULT_CORRECTIONS, CORRECTION_SCHEMA)


def first_iso_week_saturday(year: int) -> _dt.date:
    """Saturday of ISO week 1 of ``year``."""
    jan4 = _dt.date(year, 1, 4)
    monday = jan4 - _dt.timedelta(days=jan4.weekday())
    return monday + _dt.timedelta(days=5)


def iso_week_saturday(year: int, week: int) -> _dt.date:
    return first_iso_week_saturday(year) + _dt.timedelta(days=7 * (week - 1))


ACCOUNT_RULE_SCHEMA = "rule_id int, retailer string, state string, channel string, category string, action string, factor double"

# Corrections by account; NULL fits every value, a factor of 0 exempts.
DEFAULT_ACCOUNT_RULES = [
    (1, "MACHINERY", None, None, None, "scale", 2.0),
    (2, "MACHINERY", "ASIA", None, None, "scale", 1.5),
    (3, None, "ASIA", "NO", None, "scale", 3.0),
    (4, None, None, None, "PROMO", "scale", 0.5),
    (5, "BUILDING", "AMERICA", None, None, "set_ly", 1.0),
    (6, "BUILDING", "AFRICA", None, None, "set_ly", 1.0),
    (7, "HOUSEHOLD", None, "NO", "STANDARD", "close_gap", 0.5),
    (8, None, "EUROPE", None, None, "close_gap", 0.25),
    (9, "HOUSEHOLD", "EUROPE", None, None, "close_gap", 0.0),
    (10, "FURNITURE", None, None, "SMALL", "cumulative", 1.0),
    (11, None, None, "NO", "LARGE", "hold_last", 1.0),
    (12, "AUTOMOBILE", None, "NO", "LARGE", "hold_last", 0.0),
    (13, "MACHINERY", None, None, None, "scale", 9.0),
    (14, None, None, None, None, "close_gap", 0.1),
]


def account_rules(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else DEFAULT_ACCOUNT_RULES, ACCOUNT_RULE_SCHEMA)
