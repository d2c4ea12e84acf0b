"""Window operators per series: rolling statistics with observation guards,
centered windows, forward/back fill and running totals.

All are native window expressions.  Windows sharing the same partition and
order spec are evaluated by one Window operator after one shuffle, so callers
should build several outputs with the same ``partition``/``order`` in one
``select`` where possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATS = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def trailing(partition, order, k: int):
    return Window.partitionBy(*partition).orderBy(*([order] if isinstance(order, (str, Column)) else order)) \
        .rowsBetween(-(k - 1), 0)


def rolling_expr(col: str, partition, order, k: int, stat: str = "mean") -> Column:
    """Trailing k-row statistic, NULL unless all k rows hold a value
    (pandas ``rolling(k)`` semantics: a row frame counts rows, so the guard
    counts non-NULL observations)."""
    if stat not in _STATS:
        raise ValueError(f"unsupported rolling statistic {stat!r}; allowed: {sorted(_STATS)}")
    w = trailing(partition, order, k)
    return F.when(F.count(F.col(col)).over(w) == k, _STATS[stat](F.col(col)).over(w))


def rolling(df: DataFrame, partition, order, col: str, k: int, stat: str = "mean", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_{k}_roll_{stat}", rolling_expr(col, partition, order, k, stat))


def rolling_many(df: DataFrame, partition, order, cols, k: int, stat: str = "mean", suffix: str | None = None) -> DataFrame:
    """Rolling statistic over several columns in one window pass.
    Output name ``{c}_{k}_roll_{stat}`` (or ``{c}_{k}_{suffix}``)."""
    sfx = suffix or f"roll_{stat}"
    return df.withColumns({f"{c}_{k}_{sfx}": rolling_expr(c, partition, order, k, stat) for c in cols})


def centered(partition, order, half: int):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(-half, half)


def centered_mean(col: str, partition, order, size: int = 7) -> Column:
    """Centered ``size``-row mean with min 1 observation."""
    return F.avg(F.col(col)).over(centered(partition, order, size // 2))


def centered_count(cond: Column, partition, order, size: int = 7) -> Column:
    """Number of rows satisfying ``cond`` in a centered ``size``-row window."""
    return F.count(F.when(cond, 1)).over(centered(partition, order, size // 2))


def forward_fill(col: str, partition, order) -> Column:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.col(col), ignorenulls=True).over(w)


def back_fill(col: str, partition, order) -> Column:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.first(F.col(col), ignorenulls=True).over(w)


def fill_both(col: str, partition, order) -> Column:
    """Forward fill, then back fill what is still NULL (leading rows)."""
    return F.coalesce(forward_fill(col, partition, order), back_fill(col, partition, order))


def running_total(col: str, partition, order) -> Column:
    """Cumulative sum, RANGE unbounded preceding .. current row (peers on the
    same order value are included, as in SQL)."""
    w = Window.partitionBy(*partition).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(col)).over(w)
