"""Rules as a table: each rule names a value, or any value (NULL), for some key
columns, an action and a factor.  A row gets at most one rule an action, the
most specific one that fits it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 10_000  # rules up to which their tables are broadcast; more are joined by key like any table


def with_rules(df: DataFrame, rules: DataFrame, keys: list[str], out: str = "rules") -> DataFrame:
    """``df`` and a map ``out``: action -> (rule_id, factor).

    ``rules``: rule_id, the ``keys``, action, factor.  Of the rules that fit a
    row, the one that names most keys wins; of equally many, the one that names
    earlier keys; then the smallest rule_id.  A NULL in ``df`` fits only rules
    that name no value for the key.

    Rules are grouped by the keys that they name (2^keys groups at most), and
    each group is an equi-join on these keys, m:1, so rows are neither moved
    (while the rules are few) nor multiplied, and nothing is compared pairwise.
    """
    named = [F.col(k).isNotNull().alias(k) for k in keys]
    found = rules.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per group
    small = sum(r["n"] for r in found) <= BROADCAST_RULES
    groups = sorted((tuple(r[k] for k in keys) for r in found), key=lambda g: (sum(g), g), reverse=True)
    parts = []
    for i, group in enumerate(groups):
        on = [k for k, has in zip(keys, group) if has]
        mine = rules.where(" AND ".join(f"`{k}` IS {'NOT ' if has else ''}NULL" for k, has in zip(keys, group)))
        one = mine.groupBy(*on, "action").agg(F.min(F.struct("rule_id", "factor")).alias("rule"))
        table = one.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("action", "rule"))).alias(f"__rules{i}"))
        if on:
            df = df.join(F.broadcast(table) if small else table, on, "left")
        else:  # rules for all rows: one row
            entries = [(r["action"], r["rule"]["rule_id"], r["rule"]["factor"]) for r in one.collect()]
            df = df.withColumn(f"__rules{i}", F.map_from_arrays(
                F.array(*[F.lit(a) for a, _, _ in entries]),
                F.array(*[F.struct(F.lit(n).cast(rules.schema["rule_id"].dataType).alias("rule_id"),
                                   F.lit(f).cast(rules.schema["factor"].dataType).alias("factor")) for _, n, f in entries])))
        parts.append(f"__rules{i}")
    kind = (f"map<{rules.schema['action'].dataType.simpleString()},struct<rule_id:{rules.schema['rule_id'].dataType.simpleString()},"
            f"factor:{rules.schema['factor'].dataType.simpleString()}>>")
    empty = F.expr(f"CAST(map() AS {kind})")
    merged = empty
    for p in parts:  # from the most specific group on: only actions that aren't there yet
        have = F.map_keys(merged)
        merged = F.map_concat(merged, F.map_filter(F.coalesce(F.col(p), empty), lambda k, _: ~F.array_contains(have, k)))
        df = df.withColumn(out, merged)
        merged = F.col(out)
    return (df if parts else df.withColumn(out, empty)).drop(*parts)
