"""Data-quality checks.

Each check has a DataFrame form (returns the offending rows, lazily, so it can
be written out as a report) and an ``assert_*`` form that raises.  The assert
forms run one aggregation and pull at most one row to the driver.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    pass


class CoverageError(DataQualityError):
    pass


def coverage_gaps(df: DataFrame, lookup: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` present on one side only (symmetric difference).
    Columns: value, in_data, in_lookup."""
    a = df.select(F.col(col).alias("value")).distinct().withColumn("in_data", F.lit(True))
    b = lookup.select(F.col(col).alias("value")).distinct().withColumn("in_lookup", F.lit(True))
    j = a.join(b, a.value.eqNullSafe(b.value), "full").select(
        F.coalesce(a.value, b.value).alias("value"),
        F.coalesce("in_data", F.lit(False)).alias("in_data"),
        F.coalesce("in_lookup", F.lit(False)).alias("in_lookup"))
    return j.filter(~(F.col("in_data") & F.col("in_lookup")))


def assert_coverage(df: DataFrame, lookup: DataFrame, col: str) -> None:
    """Raise with every value of the (bounded) lookup that the data lack, and the
    first values that the lookup lacks with their number."""
    gaps = coverage_gaps(df, lookup, col)
    missing = sorted((r.value for r in gaps.filter(~F.col("in_data")).collect()), key=str)
    unknown = gaps.filter(~F.col("in_lookup"))
    extra = sorted((r.value for r in unknown.limit(20).collect()), key=str)
    if missing or extra:
        extra = extra if len(extra) < 20 else [*extra, f"{unknown.count()} in all"]
        raise CoverageError(f"{col} coverage mismatch: missing from data {missing}, not in lookup {extra}")


def assert_no_nulls(df: DataFrame, col: str) -> None:
    if df.filter(F.col(col).isNull()).limit(1).count():
        raise DataQualityError(f"NULL values in {col}")


def assert_columns(df: DataFrame, columns) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise DataQualityError(f"columns {gone} are missing")


def assert_distinct_count(df: DataFrame, col: str, expected: int) -> None:
    n = df.agg(F.count_distinct(col).alias("n")).first()["n"]
    if n != expected:
        raise DataQualityError(f"expected {expected} distinct {col}, found {n}")


def column_contract_diff(df: DataFrame, expected) -> list[tuple[str, str]]:
    """(column, 'missing' | 'unexpected') for a column-set contract."""
    have, want = set(df.columns), set(expected)
    return sorted([(c, "missing") for c in want - have] + [(c, "unexpected") for c in have - want])


def assert_column_contract(df: DataFrame, expected) -> None:
    diff = column_contract_diff(df, expected)
    if diff:
        raise DataQualityError(f"column contract violated: {diff}")


def assert_no_overlap(left: DataFrame, right: DataFrame, keys) -> None:
    """Sides of a merge share no column but the keys."""
    both = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if both:
        raise DataQualityError(f"both sides of the merge have {both}")


def assert_column_count(columns, expected: int, what: str = "columns") -> None:
    if len(columns) != expected:
        raise DataQualityError(f"expected {expected} {what}, received {len(columns)}")


def freshness_lag_days(df: DataFrame, col: str, as_of: _dt.date) -> DataFrame:
    """One row: latest value of ``col`` and its lag behind ``as_of`` (days)."""
    return df.agg(F.max(F.to_date(col)).alias("latest")).withColumn(
        "lag_days", F.datediff(F.lit(as_of), F.col("latest")))


def null_share(col: str):
    """Aggregate: the share of rows whose ``col`` is NULL."""
    return F.avg(F.when(F.col(col).isNull(), 1.0).otherwise(0.0)).alias(f"{col}_null_share")


def null_key_rejects(df: DataFrame, keys, name: str = "rejected_null_keys") -> DataFrame:
    """One row: how many rows have a NULL in any of ``keys`` (the rows a
    NULL-key filter drops) -- a lazy metric to write next to the output."""
    cond = None
    for k in keys:
        c = F.col(k).isNull()
        cond = c if cond is None else (cond | c)
    return df.agg(F.count(F.when(cond, 1)).alias(name), F.count(F.lit(1)).alias("rows"))


def drop_null_keys(df: DataFrame, keys, name: str = "null keys") -> tuple[DataFrame, Observation]:
    """Rows with a value in all ``keys``, and an observation (rows, rejected) that
    the action which writes them fills: no second pass over the plan."""
    seen = Observation(name)
    gone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(gone, 1)).alias("rejected"))
    return out.where(~gone), seen


def distinct_count(df: DataFrame, cols, name: str = "n_distinct") -> DataFrame:
    """One row: number of distinct combinations of ``cols`` (NULL is a value,
    as in ``select(cols).distinct().count()``)."""
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias(name))
