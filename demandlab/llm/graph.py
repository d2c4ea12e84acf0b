"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its partners; a partial aggregation comes first."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, component): one row per node that has
    an edge to another one, with the smallest node it can reach.

    Each round hooks larger partners, then smaller partners, to the smallest
    one known, until all edges form stars.  Every round is a written table, so no lineage grows and no node list reaches the
    driver; the last round's table stays, the others go with their shuffle files.  Null ends and self-loops are ignored; repeated edges count once.
    """
    stages, rounds = Stages(edges.sparkSession), 0
    cur = stages.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .distinct(), "stars-0")
    while True:
        # larger partners of u move to the smallest partner
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.where("v > u").join(_nearest(both), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # smaller partners of u and u itself move to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        rounds += 1
        cur = stages.table(small, f"stars-{rounds}")
        stages.close(keep=(f"stars-{rounds}",))
        # done when every node has one partner, which has none itself: all edges are stars
        ends = cur.select("u", F.lit(1).alias("n")).unionByName(cur.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        chained = ends.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1 OR (n = 1 AND rows > 1)")
        with stages.cleaning():
            done = chained.isEmpty()
        if done:
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def spanning_forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what all pairs (x, y) join, without cycles."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out
