"""Column-level reshaping: renames, tolerant drops, constant-column removal,
column ordering, overlap suffixes, date-column discovery, wide <-> long.

Column-name logic runs on the driver over ``df.columns`` (schema metadata,
no data); the only data-dependent step (constant columns) is a single
aggregation returning one row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename the columns present in ``mapping`` (missing names are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_tolerant(df: DataFrame, cols) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def normalise_names(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct non-NULL value.

    "Exactly one distinct value" is ``min == max`` over the non-NULL values:
    one pass of partial min/max aggregation (no distinct shuffle, no
    approximation), returning a single row to the driver."""
    if not df.columns:
        return []
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs.append(((F.min(col) == F.max(col)) & (F.count(col) > 0)).alias(f"c{i}"))
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def front_columns(df: DataFrame, front) -> DataFrame:
    """``front`` first (in the given order), the rest alphabetical."""
    rest = sorted(c for c in df.columns if c not in front)
    return df.select(*[c for c in front if c in df.columns], *rest)


def suffix_overlap(left: DataFrame, right: DataFrame, keys, suffix: str) -> DataFrame:
    """Rename ``right``'s non-key columns that also occur in ``left``."""
    overlap = (set(left.columns) & set(right.columns)) - set(keys)
    return right.withColumnsRenamed({c: f"{c}{suffix}" for c in overlap})


# A column is a date column when "date" is a whole token: delimited by the
# string edge, whitespace, '_' or '-' (case-insensitive).
DATE_TOKEN = re.compile(r"(^|[\s_-])date($|[\s_-])", re.IGNORECASE)


def date_columns(columns) -> list[str]:
    return [c for c in columns if DATE_TOKEN.search(c)]


def cast_date_columns(df: DataFrame, to: str = "timestamp") -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast(to) for c in date_columns(df.columns)})


def columns_with(df: DataFrame, token: str) -> list[str]:
    return [c for c in df.columns if token in c.lower()]


def wide_to_long(df: DataFrame, ids, values, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var_name, value_name)
