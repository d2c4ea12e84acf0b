"""Data-quality expectations: a list of checks compiled into one aggregation of
the data, one row a check.

Checks of rows (a predicate that must hold) and checks of the whole table
(a condition on aggregates) share the pass.  Uniqueness needs its rows grouped
by the key, so all checks of one key become one further aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlab.operators.quality import DataQualityError

REPORT = "check string, passed boolean, violations long, example string"


@dataclass(frozen=True)
class Check:
    """``holds``: condition of a row (NULL counts as a violation), or with
    ``table`` of aggregates; ``unique``: key columns whose values occur once."""
    name: str
    holds: Column | None = None
    table: bool = False
    unique: tuple[str, ...] = ()


def not_null(col: str) -> Check:
    return Check(f"{col} is not null", F.col(col).isNotNull())


def between(col: str, low, high) -> Check:
    return Check(f"{col} in {low}..{high}", F.col(col).isNull() | F.col(col).between(low, high))


def one_of(col: str, values) -> Check:
    return Check(f"{col} is a known value", F.col(col).isNull() | F.col(col).isin(*values))


def matches(col: str, pattern: str) -> Check:
    return Check(f"{col} matches {pattern}", F.col(col).isNull() | F.col(col).rlike(pattern))


def holds(name: str, condition: Column) -> Check:
    return Check(name, condition)


def distinct_values(col: str, expected: int) -> Check:
    return Check(f"{expected} values of {col}", F.count_distinct(col) == expected, table=True)


def fresh(col: str, as_of, days: int) -> Check:
    return Check(f"{col} within {days} days", F.datediff(F.lit(as_of), F.max(F.to_date(col))).between(0, days), table=True)


def at_least_rows(n: int) -> Check:
    return Check(f"at least {n} rows", F.count(F.lit(1)) >= n, table=True)


def unique(*keys: str) -> Check:
    return Check(f"{', '.join(keys)} is unique", unique=keys)


def columns_are(df: DataFrame, expected) -> list[tuple[str, bool, int, str | None]]:
    """The column contract, from the schema alone: a report row."""
    wrong = sorted(set(df.columns) ^ set(expected))
    return [("columns", not wrong, len(wrong), wrong[0] if wrong else None)]


def report(df: DataFrame, checks: list[Check], example: list[str], columns=None) -> DataFrame:
    """check, passed, violations, example: a row per check, lazily.

    violations counts rows (of a check of the table: 1 if it fails; of a key:
    the rows beyond the first of their key); example is the smallest violating
    row's ``example`` columns, joined by '|', NULL values as '?'.  On an empty
    table checks of rows and keys pass.  With ``columns``, a row for the column
    contract is added.
    """
    shown = lambda cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols])
    parts = []
    whole = [c for c in checks if not c.unique]
    if whole:
        aggregates = []
        for i, c in enumerate(whole):
            if c.table:
                ok = F.coalesce(c.holds, F.lit(False))
                aggregates += [F.when(ok, 0).otherwise(1).cast("long").alias(f"n{i}"), F.lit(None).cast("string").alias(f"x{i}")]
            else:
                bad = ~F.coalesce(c.holds, F.lit(False))
                aggregates += [F.count(F.when(bad, 1)).alias(f"n{i}"), F.min(F.when(bad, shown(example))).alias(f"x{i}")]
        parts.append((df.agg(*aggregates), [c.name for c in whole]))
    for keys in sorted({c.unique for c in checks if c.unique}):
        names = [c.name for c in checks if c.unique == keys]
        many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
        one = many.agg(F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("n0"), F.min(shown(keys)).alias("x0"))
        parts.append((one.select(*[c for i in range(len(names)) for c in (F.col("n0").alias(f"n{i}"), F.col("x0").alias(f"x{i}"))]), names))
    out = df.sparkSession.createDataFrame(columns_are(df, columns) if columns is not None else [], REPORT)
    for row, names in parts:
        items = F.array(*[F.struct(F.lit(n).alias("check"), (F.col(f"n{i}") == 0).alias("passed"), F.col(f"n{i}").alias("violations"),
                                   F.col(f"x{i}").alias("example")) for i, n in enumerate(names)])
        out = out.unionByName(row.select(F.inline(items)))
    return out


def enforce(df: DataFrame, checks: list[Check], example: list[str], columns=None) -> None:
    """Raise with all failed checks."""
    failed = report(df, checks, example, columns).where("NOT passed").orderBy("check").collect()  # a row per check
    if failed:
        raise DataQualityError("; ".join(f"{r['check']}: {r['violations']} (e.g. {r['example']})" for r in failed))
