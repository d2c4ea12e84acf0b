"""Least squares per group by normal equations: the sums of products are one
aggregation, the small system is solved by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST_PIVOT = 1e-9  # share of a term's sum of squares left, below which it depends on the terms before it


def fit_groups(rows: DataFrame, keys: list[str], terms: list[Column], target: str, ridge: list[float], extra: dict[str, Column] | None = None) -> DataFrame:
    """Per group of ``keys``: coefficients ``beta0``, ``beta1``, ... of ``terms``
    that minimise the squared error of ``target`` plus ridge_j * beta_j^2; and
    the aggregates ``extra``.

    Only rows with a target count.  One hash aggregation with map-side sums, so
    a group may hold any number of rows; what follows is an expression per
    group.  A term that depends on the terms before it gets 0.
    """
    n = len(terms)
    rows = rows.where(F.col(target).isNotNull()).withColumns({f"__x{j}": x.cast("double") for j, x in enumerate(terms)})
    sums = {f"__a{i}_{j}": F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i in range(n) for j in range(i + 1)}
    sums |= {f"__b{i}": F.sum(F.col(f"__x{i}") * F.col(target)) for i in range(n)}
    extra = extra or {}
    out = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in (sums | extra).items()])
    c = F.col
    for j in range(n):  # A = L D L', column by column; z = solution of L z = b
        left = lambda i, j=j: sum((c(f"__l{i}_{k}") * c(f"__l{j}_{k}") * c(f"__d{k}") for k in range(j)), F.lit(0.0))
        whole = c(f"__a{j}_{j}") + F.lit(float(ridge[j]))
        out = out.withColumn(f"__d{j}", whole - left(j))
        out = out.withColumn(f"__d{j}", F.when(c(f"__d{j}") > SMALLEST_PIVOT * whole, c(f"__d{j}")).otherwise(0.0))
        step = {f"__l{i}_{j}": F.when(c(f"__d{j}") > 0, (c(f"__a{i}_{j}") - left(i)) / c(f"__d{j}")).otherwise(0.0) for i in range(j + 1, n)}
        step[f"__z{j}"] = c(f"__b{j}") - sum((c(f"__l{j}_{k}") * c(f"__z{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumns(step)
    for j in reversed(range(n)):
        rest = sum((c(f"__l{i}_{j}") * c(f"beta{i}") for i in range(j + 1, n)), F.lit(0.0))
        out = out.withColumn(f"beta{j}", F.when(c(f"__d{j}") > 0, c(f"__z{j}") / c(f"__d{j}") - rest).otherwise(0.0))
    return out.select(*keys, *[f"beta{j}" for j in range(n)], *extra)
