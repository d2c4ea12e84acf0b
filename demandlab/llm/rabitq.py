"""Near-duplicate vectors by randomised-rotation binary codes.

Every unit vector is turned by seeded random rotations; the signs of all
rotated coordinates are its binary code.  With the stored correction factor
(the inner product of the vector with its own code vector), code . query /
factor is an unbiased estimate of the inner product, and its error is bounded
by the factor and the code length.  Pairs whose upper confidence bound reaches
the threshold are computed again exactly, in double precision; only those
results decide.

Candidates are vectors that agree in all sampled code bits of one of several
tables.  A pair is handled in the first table where it meets, so it counts
once.  Large buckets are cut into blocks and handled as pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .graph import connected_components, spanning_forest

ROTATIONS = 4         # code length / dimension
CONFIDENCE = 4.0      # standard errors of the upper bound (misses about 3 of 100,000 pairs at the threshold)
BUCKET = 64           # rows per bucket that the number of sampled bits aims at
MISS = 0.0005         # share of pairs at the threshold that may meet in no table
BLOCK = 512           # rows of a bucket that meet in one task


def rotations(dim: int, seed: int = 7) -> np.ndarray:
    """Seeded random orthogonal matrices side by side: dim x (ROTATIONS * dim)."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)])


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column whose rows are usable (see near_duplicates)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bits of each row, and its correction factor: the inner product of the
    turned vector with the unit vector of its signs."""
    turned = unit @ turn
    return turned > 0, np.abs(turned).sum(1) / (math.sqrt(turned.shape[1]) * math.sqrt(ROTATIONS))


def tables(n: int, dim: int, threshold: float, seed: int = 11) -> np.ndarray:
    """Sampled code bits of every table: bits so that buckets hold about BUCKET
    rows, tables so that a pair at the threshold meets with 1 - MISS."""
    bits = max(4, min(30, math.ceil(math.log2(max(n, 2) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    count = math.ceil(math.log(MISS) / math.log1p(-same))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(dim * ROTATIONS, bits, replace=False) for _ in range(count)])


def bucket_ids(code: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Row x table: the bucket of the row in each table."""
    weight = np.int64(1) << np.arange(chosen.shape[1], dtype=np.int64)
    return np.stack([code[:, c].astype(np.int64) @ weight for c in chosen], 1) if len(code) else np.zeros((0, len(chosen)), np.int64)


def near_pairs(unit: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i < j) of rows with cosine >= threshold and how many were recomputed."""
    code, factor = encode(unit, turn)
    length = turn.shape[1]
    signs = np.where(code, 1.0, -1.0) / math.sqrt(length)
    guess = (signs @ (unit @ turn / math.sqrt(ROTATIONS)).T) / factor[:, None]
    error = np.sqrt((1 - factor ** 2) / factor ** 2 / (length - 1))[:, None]
    upper = np.maximum(guess + CONFIDENCE * error, (guess + CONFIDENCE * error).T)
    i, j = np.nonzero(np.triu(upper >= threshold, 1))
    exact = np.einsum("ij,ij->i", unit[i], unit[j])
    ok = exact >= threshold
    return i[ok], j[ok], len(i)


def _place(dim: int, n: int, threshold: float):
    def run(batches):
        turn, chosen = rotations(dim), tables(n, dim, threshold)
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = bucket_ids(encode(unit_rows(b.column("embedding"), dim), turn)[0], chosen)
            for t in range(len(chosen)):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(ids[:, t])],
                                                 ["node", "table", "bucket"])
    return run


def _compare(dim: int, n: int, threshold: float):
    """Rows of a cell come together: per cell, partial link counts and a forest."""
    def links_of(rows: pa.RecordBatch, turn, chosen):
        t, same = rows.column("table")[0].as_py(), rows.column("same")[0].as_py()
        node, copies, block = (rows.column(c).to_numpy() for c in ("node", "copies", "block"))
        unit = unit_rows(rows.column("embedding"), dim)
        i, j, _ = near_pairs(unit, turn, threshold)
        crossing = (block[i] == block[j]) if same else (block[i] != block[j])
        i, j = i[crossing], j[crossing]
        if len(i) and t:  # an earlier table has compared those that also met there
            ids = bucket_ids(encode(unit, turn)[0], chosen[:t])
            first = np.array([not (ids[x] == ids[y]).any() for x, y in zip(i, j)]) if len(i) < 1000 else np.concatenate(
                [~(ids[i[k:k + 100000]] == ids[j[k:k + 100000]]).any(1) for k in range(0, len(i), 100000)])
            i, j = i[first], j[first]
        if not len(i):
            return None
        links = (np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))).astype(np.int64)
        some = np.flatnonzero(links)
        forest = spanning_forest(node[i], node[j])
        return pa.RecordBatch.from_arrays(
            [pa.array(node[some].tolist() + [x for x, _ in forest], pa.int64()),
             pa.array([None] * len(some) + [y for _, y in forest], pa.int64()),
             pa.array(links[some].tolist() + [0] * len(forest), pa.int64())], ["node", "other", "links"])

    def run(batches):
        turn, chosen = rotations(dim), tables(n, dim, threshold)
        held = None
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            if b.num_rows == 0:
                continue
            cell = b.column("cell").to_numpy()
            cut = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if hi - lo > 1 and (out := links_of(b.slice(lo, hi - lo), turn, chosen)) is not None:
                    yield out
            held = b.slice(int(cut[-1]))
        if held is not None and held.num_rows > 1 and (out := links_of(held, turn, chosen)) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept.

    Rows link when the cosine of their embeddings, in double precision, is at
    least ``threshold``; n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable.  Embeddings that are null,
    empty, zero, of another length than most, or hold a null or non-finite
    component link with nothing.  Equal embeddings are one node with a count of
    copies.  Rows with a null vec_id link with nothing and have a null
    component.  Other columns are ignored.
    """
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    size = (rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
            .orderBy(F.desc("count"), "d").first())
    dim = size["d"] if size else 1
    usable = ((F.size("embedding") == dim) & F.col("vec_id").isNotNull()
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    rows = stage_table(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    nodes = stage_table(rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes")
    n = nodes.count()

    placed = stage_table(nodes.select("node", "embedding").mapInArrow(_place(dim, n, threshold), "node long, table int, bucket long"), "places")
    crowd = placed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1") \
        .select("table", "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = (placed.join(crowd, ["table", "bucket"]).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("node", "table", "block", (F.col("block") == F.col("other")).alias("same"),
                     F.xxhash64("table", "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell")))
    found = stage_table(cells.join(nodes, "node").repartition("cell").sortWithinPartitions("cell")
                        .mapInArrow(_compare(dim, n, threshold), "node long, other long, links long"), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = stage_table(nodes.join(counts, "node", "left").join(parts, "node", "left")
                        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                                F.coalesce("component", "node").alias("component")), "facts")
    out = rows.join(facts.withColumn("usable", F.lit(True)), ["embedding", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
