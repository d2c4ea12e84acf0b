"""Hard negatives by an STR-packed R-tree over integer vectors.

Vectors are dealt by ranges of (label, first coordinates) to tiles; every tile
is packed by sort-tile-recursive cuts along its coordinates of greatest
variance into leaves, whose minimum bounding boxes are stored beside the rows.
Consecutive boxes are joined level by level up to the tile's root.  For an
anchor, a box gives an interval of inner products coordinate by coordinate.  A
best-first queue opens boxes by their upper ends, and drops a box that lies
outside the score window, or strictly below the kth score found, or that holds
no row of a fitting label.

Anchors come in blocks of about ``BLOCK_ANCHORS``; every block reads all tiles
twice, for the positives and for the negatives.  The best of each tile are
merged by a window in two steps.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

SCALE = 256
TILE_ROWS = 8192
LEAF = 64
FAN = 8               # boxes of a level under one box of the next
OPEN = 4              # leaves opened at a time
BLOCK_ANCHORS = 20_000
ANCHORS_AT_ONCE = 256
LONG = (1 << 63) - 1

TILE_KIND = "tile long, ids binary, nulls binary, labels binary, x binary, wide boolean, ends binary, lo binary, hi binary"
FOUND_KIND = "anchor long, place int, tile long, vec_id long, score long"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole doubles."""
    return np.floor(x.astype(np.float64) * SCALE)


def exact(dim: int, *arrays: np.ndarray) -> bool:
    """True if all inner products are exact in doubles."""
    return dim * math.prod(max(1.0, float(np.abs(a).max(initial=0))) for a in arrays) < 2.0 ** 52


def as_whole_numbers(x: np.ndarray) -> np.ndarray:
    """Python integers, for vectors too large for exact doubles."""
    return np.frompyfunc(int, 1, 1)(x) if x.size else x.astype(object)


def pack(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Sort-tile-recursive order of the rows and the ends of the leaves.  Rows of
    a label come together; they are cut into equal slabs along one coordinate
    after the other, as many as the leaves need."""
    order, sizes = [], []

    def cut(rows: np.ndarray, axes: list[int]) -> None:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not axes:
            order.append(rows)
            sizes.extend([leaf] * (len(rows) // leaf) + ([len(rows) % leaf] if len(rows) % leaf else []))
            return
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        slab = leaf * -(-leaves // math.ceil(leaves ** (1 / len(axes))))
        for a in range(0, len(rows), slab):
            cut(rows[a:a + slab], axes[1:])

    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        leaves = -(-len(rows) // leaf)
        spread = x[rows].max(0) - x[rows].min(0) if not np.isfinite(v := x[rows].var(0)).all() else v
        axes = np.argsort(-spread, kind="stable")[:max(1, math.ceil(math.log2(max(leaves, 2))))]
        cut(rows, axes.tolist())
    return np.concatenate(order), np.cumsum(sizes)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _tiles(dim: int):
    """Rows of a task -> packed tiles."""
    def tile(rows: pa.Table, number: int) -> pa.RecordBatch:
        x = whole(np.asarray(rows.column("embedding").combine_chunks().flatten())).reshape(-1, dim)
        labels = rows.column("label").to_numpy()
        order, ends = pack(x, labels)
        x, starts = x[order], np.r_[0, ends[:-1]]
        wide = not float(np.abs(x).max(initial=0)) < 2 ** 24
        kind = "<f8" if wide else "<f4"
        ids = rows.column("vec_id")
        values = [pc.fill_null(ids, 0).to_numpy()[order].astype("<i8"), pc.is_null(ids).to_numpy()[order], labels[order].astype("<i8"),
                  x.astype(kind)]
        boxes = [np.minimum.reduceat(x, starts).astype(kind), np.maximum.reduceat(x, starts).astype(kind)]
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() << 24 | number], pa.int64())] + [pa.array([_squeeze(v)], pa.binary()) for v in values]
            + [pa.array([wide])] + [pa.array([_squeeze(v)], pa.binary()) for v in (ends.astype("<i8"), *boxes)],
            [c.split()[0] for c in TILE_KIND.split(", ")])

    def run(batches):
        held, filled, made = [], 0, 0
        for b in batches:
            for a in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(a, TILE_ROWS)
                held.append(part)
                filled += part.num_rows
                if filled >= 2 * TILE_ROWS:
                    yield tile(pa.Table.from_batches(held), made)
                    held, filled, made = [], 0, made + 1
        if filled:
            yield tile(pa.Table.from_batches(held), made)

    return run


class Tree:
    """A tile: its rows, and the boxes of all levels from the leaves up."""

    def __init__(self, row: dict, dim: int, queries: np.ndarray):
        kind = "<f8" if row["wide"] else "<f4"
        self.ids, self.nulls, self.labels = _spread(row["ids"], "<i8"), _spread(row["nulls"], "?"), _spread(row["labels"], "<i8")
        self.x = _spread(row["x"], kind).reshape(-1, dim).astype(np.float64)
        self.ends = _spread(row["ends"], "<i8")
        self.starts = np.r_[0, self.ends[:-1]]
        self.fits = exact(dim, self.x, queries)
        lo, hi = (_spread(row[c], kind).reshape(-1, dim).astype(np.float64) for c in ("lo", "hi"))
        if not self.fits:
            self.x, lo, hi = (as_whole_numbers(v) for v in (self.x, lo, hi))
        first, last = self.labels[self.starts], self.labels[self.ends - 1]  # a leaf has one label
        self.levels = [(lo, hi, first, last)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((lo, hi, first, last))

    def intervals(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level: least and greatest inner product of each query with any
        point of each box, summed coordinate by coordinate."""
        q = queries if self.fits else as_whole_numbers(queries)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [(up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T) for lo, hi, _, _ in self.levels]

    def scores(self, query: np.ndarray, known: dict[int, np.ndarray], leaves: list[int]) -> None:
        """Inner products of the rows of ``leaves``, each computed once."""
        new = [leaf for leaf in leaves if leaf not in known]
        if new:
            rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in new])
            cut = np.cumsum([self.ends[i] - self.starts[i] for i in new])[:-1]
            known.update(zip(new, np.split(self.x[rows] @ query, cut)))

    def best(self, bounds: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, known: dict, label: int, same: bool, but: int,
             k: int, least: int | None = None, greatest: int | None = None) -> tuple[list[int], int]:
        """The first ``k`` rows with ``label`` (or, unless ``same``, another one)
        and a score between ``least`` and ``greatest``, without the rows of the
        id ``but``: (their places by score, then id; leaves opened)."""
        top = len(self.levels) - 1
        queue: list[tuple] = []
        opened = 0

        def push(level: int, nodes) -> None:
            lower, upper = bounds[level]
            _, _, first, last = self.levels[level]
            for i in nodes:
                lo, hi = lower[i], upper[i]
                if (least is not None and hi < least) or (greatest is not None and lo > greatest):
                    continue
                if (not first[i] <= label <= last[i]) if same else (first[i] == label == last[i]):
                    continue
                if len(place) < k or hi >= kth:
                    heapq.heappush(queue, (-(hi if greatest is None else min(hi, greatest)), level, i))

        place, score, kth = np.zeros(0, np.int64), np.zeros(0, self.x.dtype), None
        push(top, range(len(self.levels[top][2])))
        while queue:
            if len(place) >= k and -queue[0][0] < kth:
                break
            leaves: list[int] = []
            while queue and len(leaves) < OPEN:
                if len(place) >= k and -queue[0][0] < kth:
                    break
                _, level, i = heapq.heappop(queue)
                if level == 0:
                    leaves.append(i)
                else:
                    push(level - 1, range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][2]))))
            if not leaves:
                continue
            opened += len(leaves)
            self.scores(query, known, leaves)
            at = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in leaves])
            s = np.concatenate([known[i] for i in leaves])
            ok = ((self.labels[at] == label) == same) & (self.nulls[at] | (self.ids[at] != but))
            if least is not None:
                ok &= (s >= least) & (s <= greatest)
            if len(place) >= k:
                ok &= s >= kth
            ok = ok.astype(bool)
            if ok.any():
                place, score = np.r_[place, at[ok]], np.r_[score, s[ok]]
                order = np.lexsort((self.ids[place], self.nulls[place], -score))[:k]
                place, score = place[order], score[order]
                if len(place) >= k:
                    kth = score[-1]
        return [(int(p), int(s)) for p, s in zip(place, score)], opened


def window_of(positive: int) -> tuple[int, int]:
    """Scores s with 30 positive <= 100 s <= 90 positive (none if the first is larger)."""
    return -((-30 * positive) // 100), (90 * positive) // 100


def _search(dim: int, shared, k: int, positives):
    """Best rows of every tile: positives of each anchor, or, given these, the
    negatives of each anchor and positive."""
    def run(batches):
        ids, labels, vectors = shared.value
        asked = None if positives is None else positives.value
        for b in batches:
            for row in b.to_pylist():
                tree = Tree(row, dim, vectors)
                out = [[], [], [], [], []]
                for a in range(0, len(ids), ANCHORS_AT_ONCE):
                    some = vectors[a:a + ANCHORS_AT_ONCE]
                    bounds = tree.intervals(some)
                    for i in range(len(some)):
                        mine = [(lower[i], upper[i]) for lower, upper in bounds]
                        query = some[i] if tree.fits else as_whole_numbers(some[i])
                        n, known = a + i, {}
                        if asked is None:
                            found = [(0, tree.best(mine, query, known, labels[n], True, ids[n], k)[0])]
                        else:
                            windows: dict = {}
                            for place, positive in asked.get(n, ()):
                                w = window_of(positive)
                                if w[0] <= w[1] and w not in windows:
                                    windows[w] = tree.best(mine, query, known, labels[n], False, ids[n], k, *w)[0]
                            found = [(place, windows.get(window_of(positive), [])) for place, positive in asked.get(n, ())]
                        for place, rows in found:
                            out[0] += [n] * len(rows)
                            out[1] += [place] * len(rows)
                            out[2] += [row["tile"]] * len(rows)
                            out[3] += [None if tree.nulls[p] else int(tree.ids[p]) for p, _ in rows]
                            out[4] += [max(-LONG - 1, min(LONG, s)) for _, s in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int32() if j == 1 else pa.int64()) for j, v in enumerate(out)],
                    [c.split()[0] for c in FOUND_KIND.split(", ")])

    return run


def _merged(found: DataFrame, k: int, tiles: int) -> DataFrame:
    """The first k of each anchor and place, over all tiles, with their rank."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    parts = max(1, math.isqrt(tiles))
    first = F.row_number().over(Window.partitionBy("anchor", "place", "part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    return (found.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts))).withColumn("rank", first).where(F.col("rank") <= k)
            .withColumn("rank", last).where(F.col("rank") <= k).drop("part", "tile"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """``vectors`` (vec_id, embedding, label, ...) -> anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part, nor do those of another length than most.  Where vec_id is
    divisible by 7, label becomes (label + 1) % 10.  Components become
    floor(256 x); a score is the inner product with the anchor, larger first,
    ties by vec_id, null last.  Anchors are rows whose vec_id is divisible by
    ``every``; its positives are the first rows of the same label and another
    id, its negatives for a positive the first rows of another label with
    30 * positive_score <= 100 * negative_score <= 90 * positive_score.

    Repeated rows are each a possible positive or negative; a repeated anchor
    counts once, and rows with an anchor's id and another vector or label are
    anchors of their own.  Scores beyond the range of a long count as its
    ends.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                          F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    rows = rows.where("label IS NOT NULL AND size(embedding) > 0").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if sizes is None:
        return spark.createDataFrame([], kind)
    dim = sizes["d"]
    rows = rows.where(F.size("embedding") == dim)
    # equal labels and coordinates are told apart by the id, so no range is hot
    dealt = rows.repartitionByRange(max(1, -(-sizes["count"] // TILE_ROWS)), "label", F.col("embedding")[0],
                                    F.col("embedding")[min(1, dim - 1)], F.xxhash64("vec_id"), "vec_id")
    tree = stage_table(dealt.mapInArrow(_tiles(dim), TILE_KIND), "tiles")
    tiles = tree.count()
    anchors = stage_table(rows.where(F.col("vec_id") % every == 0).distinct(), "anchors")
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    out = None
    for number in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)) == number).orderBy("vec_id", "label").toArrow()
        if block.num_rows == 0:
            continue
        ids = block.column("vec_id").to_pylist()
        shared = spark.sparkContext.broadcast((ids, block.column("label").to_pylist(), whole(
            np.asarray(block.column("embedding").combine_chunks().flatten())).reshape(-1, dim)))
        near = stage_table(_merged(tree.mapInArrow(_search(dim, shared, positives, None), FOUND_KIND), positives, tiles)
                           .select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), "positives")
        asked: dict = {}
        for r in near.select("anchor", "place", "positive_score").toLocalIterator():  # a few rows an anchor of the block
            asked.setdefault(r["anchor"], []).append((r["place"], r["positive_score"]))
        far = _merged(tree.mapInArrow(_search(dim, shared, negatives, spark.sparkContext.broadcast(asked)), FOUND_KIND), negatives, tiles)
        names = spark.createDataFrame(list(enumerate(ids)), "anchor long, anchor_id long")
        part = stage_table(far.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
                           .join(near, ["anchor", "place"]).join(F.broadcast(names), "anchor")
                           .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                                   "negative_score"), "negatives")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kind)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
