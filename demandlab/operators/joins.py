"""Join helpers: cardinality-checked joins, NULL-safe joins, scalar attach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class JoinValidationError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once (empty when ``keys`` is unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys, side: str = "right") -> None:
    """Raise when ``keys`` is not unique in ``df``.  One aggregation + ``take(1)``
    (the check stops at the first offending key; nothing big reaches the driver)."""
    bad = duplicate_keys(df, keys).take(1)
    if bad:
        raise JoinValidationError(f"{side} side is not unique on {list(keys)}: e.g. {bad[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, on, how: str = "left", validate: str = "m:1") -> DataFrame:
    """Join after checking the declared cardinality ('1:1', 'm:1', '1:m', 'm:m').

    Uniqueness of the join keys on the "1" side(s) is what keeps the row count
    of a left join unchanged, so it is checked instead of counting rows before
    and after (cheaper: one aggregation of the smaller side).
    """
    keys = [on] if isinstance(on, str) else list(on)
    l_one, r_one = {"1:1": (True, True), "m:1": (False, True), "1:m": (True, False), "m:m": (False, False)}[validate]
    if r_one:
        assert_unique(right, keys, "right")
    if l_one:
        assert_unique(left, keys, "left")
    return left.join(right, keys, how)


class ObservedJoins:
    """Cardinality-checked joins whose checks are observed metrics of the plan
    that writes the result: no job of their own.

    ``join`` adds to each "1" side how often its key occurs (the window needs
    the distribution and order that the join needs anyway).  After the write,
    ``verify`` raises where a key occurred more than once, and ``metrics`` has
    a row per join.  Counts of rows may include rows that were read again after
    the loss of an executor; the checks rest on maxima, which don't change then.
    """

    def __init__(self):
        self._joins: list[tuple[str, list[str], dict[str, Observation], tuple[bool, bool]]] = []

    def join(self, name: str, left: DataFrame, right: DataFrame, on, validate: str = "m:1") -> DataFrame:
        """Left join; the right side's columns must not be named like left ones."""
        keys = [on] if isinstance(on, str) else list(on)
        one = {"1:1": (True, True), "m:1": (False, True), "1:m": (True, False), "m:m": (False, False)}[validate]
        seen: dict[str, Observation] = {}

        def observed(df: DataFrame, side: str, unique: bool) -> DataFrame:
            seen[side] = Observation(f"{name} {side}")
            rows = F.count(F.lit(1)).alias("rows")
            if not unique:
                return df.observe(seen[side], rows)
            times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
            return df.withColumn("__times", times).observe(seen[side], rows, F.max("__times").alias("most")).drop("__times")

        out = observed(left, "left", one[0]).join(observed(right, "right", one[1]).withColumn("__met", F.lit(True)), keys, "left")
        seen["out"] = Observation(f"{name} out")
        out = out.observe(seen["out"], F.count(F.lit(1)).alias("rows"), F.count("__met").alias("met")).drop("__met")
        self._joins.append((name, keys, seen, one))
        return out

    def verify(self) -> None:
        """Raise if a side that must be unique isn't; call after the write."""
        for name, keys, seen, one in self._joins:
            for side, unique in zip(("left", "right"), one):
                if unique and (seen[side].get.get("most") or 0) > 1:
                    raise JoinValidationError(f"merge {name}: {side} side is not unique on {keys}")

    def metrics(self, spark: SparkSession) -> DataFrame:
        """(merge, rows_left, rows_right, rows_out, rows_met): a row per join."""
        rows = [(name, *(int(seen[s].get["rows"]) for s in ("left", "right", "out")), int(seen["out"].get["met"])) for name, _, seen, _ in self._joins]
        return spark.createDataFrame(rows, "merge string, rows_left long, rows_right long, rows_out long, rows_met long")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join where NULL matches NULL; key columns are taken from the left
    (or coalesced for full joins)."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in keys])
    j = left.join(renamed, cond, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        j = j.select(*[F.coalesce(left[c], renamed[f"__r_{c}"]).alias(c) for c in keys],
                     *[c for c in j.columns if c not in keys and not c.startswith("__r_")])
        return j
    return j.drop(*[f"__r_{c}" for c in keys])


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the values of a one-row global aggregate (a global max, a
    national date ...) to every row of ``df`` as typed literals.

    ``one_row`` must be a global aggregate (exactly one row by construction).
    It is evaluated once (one small job returning one row to the driver) and
    its values become literals: no join of any kind is planned, and the
    optimizer can fold the constants into downstream predicates.
    """
    row = one_row.first()
    if row is None:
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in one_row.schema.fields})
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema.fields})


def salted_join(big: DataFrame, small: DataFrame, on, how: str = "left", buckets: int = 16,
                salt_cols=None) -> DataFrame:
    """Many-to-one equi-join that spreads hot keys of ``big`` over ``buckets``
    tasks (for when one key holds a large share of the rows and adaptive
    skew handling is unavailable).

    ``big`` rows get a salt = pmod(xxhash64(salt_cols), buckets): a hash, not
    ``rand()``, so a retried task reproduces exactly the same partitioning
    after an executor loss.  ``small`` (the "one" side) is replicated once per
    salt value, i.e. it grows by ``buckets``x, never with ``big``.  No row is
    dropped or duplicated in the result.
    """
    keys = [on] if isinstance(on, str) else list(on)
    cols = list(salt_cols) if salt_cols else [c for c in big.columns if c not in keys]
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(buckets)))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return b.join(s, keys + ["__salt"], how).drop("__salt")


def key_shares(df: DataFrame, key, top: int = 5) -> DataFrame:
    """Heaviest key values and their share of all rows (a skew report; one
    aggregation, top-n only reaches the driver if collected)."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return attach_scalars(counts, total).withColumn("share", F.col("rows") / F.col("total")) \
        .orderBy(F.desc("rows")).limit(top)
