"""Hard negatives against a plain version over all rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from demandlab.llm import rtree


def plain(rows, every, positives, negatives):
    """rows (vec_id, embedding, label) with usable vectors of one length."""
    v = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in e]) for i, e, label in rows]
    out = []
    seen = set()
    for a, label, q in v:
        if a is None or a % every or (a, label, tuple(q)) in seen:
            continue
        seen.add((a, label, tuple(q)))
        scored = [(-sum(x * y for x, y in zip(q, e)), i is None, i or 0, i, lab) for i, lab, e in v if i != a]
        for p in sorted(s for s in scored if s[4] == label)[:positives]:
            far = sorted(s for s in scored if s[4] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:negatives]
            out += [(a, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(far, 1)]
    return Counter(out)


def vectors(n=900, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((10, dim))
    rows = []
    for k in range(n):
        label = int(rng.integers(0, 10))
        e = centre[label] + 0.8 * rng.standard_normal(dim)
        rows.append((k, [float(x) for x in e], label))
    copies = [(2000 + k, rows[5][1], k % 3) for k in range(300)]       # a hot vector under several labels
    return rows + copies + [rows[7], rows[7], (None, rows[9][1], 4), (100, rows[30][1], 2)]


ODD = [(700_000, None, 1), (700_100, [1.0] * 12, None), (700_200, [float("nan")] + [1.0] * 11, 1), (700_300, [None] + [1.0] * 11, 1),
       (700_400, [float("inf")] + [1.0] * 11, 1), (700_500, [], 1), (700_600, [1.0] * 5, 1)]
KIND = "vec_id long, embedding array<double>, label int, anchor long, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], KIND).repartition(3)


def test_negatives_equal_plain_version(spark, monkeypatch):
    rows = vectors()
    want = plain(rows, 20, 5, 10)
    got = Counter(map(tuple, rtree.hard_negatives(table(spark, rows + ODD), 20).collect()))
    assert got == want and len(want) > 500
    monkeypatch.setattr(rtree, "TILE_ROWS", 200)       # several tiles
    monkeypatch.setattr(rtree, "BLOCK_ANCHORS", 15)    # and blocks of anchors
    assert Counter(map(tuple, rtree.hard_negatives(table(spark, rows + ODD), 20).collect())) == want


def test_vectors_beyond_exact_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) * 2.0 ** 11 for x in rng.integers(-2000, 2000, 4)], k % 3) for k in range(0, 200, 2)]
    want = plain(rows, 20, 5, 10)
    assert Counter(map(tuple, rtree.hard_negatives(table(spark, rows), 20).collect())) == want and want


def test_nothing_to_mine(spark):
    assert rtree.hard_negatives(table(spark, ODD)).collect() == []
    assert rtree.hard_negatives(table(spark, ODD).limit(0)).collect() == []
    lone = [(100, [1.0, 2.0], 1), (200, [0.0, 0.0], 2)]
    assert rtree.hard_negatives(table(spark, lone)).collect() == []


def tree_of(x, labels, queries):
    rows = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "label": pa.array(labels, pa.int64()),
                     "embedding": pa.array([list(map(float, e)) for e in x], pa.list_(pa.float64()))})
    order, ends = rtree.pack(rtree.whole(x), np.array(labels))
    starts = np.r_[0, ends[:-1]]
    v = rtree.whole(x)[order]
    row = {"wide": True, "ids": rtree._squeeze(rows["vec_id"].to_numpy()[order].astype("<i8")), "nulls": rtree._squeeze(np.zeros(len(x), bool)),
           "labels": rtree._squeeze(np.array(labels)[order].astype("<i8")), "x": rtree._squeeze(v), "ends": rtree._squeeze(ends.astype("<i8")),
           "lo": rtree._squeeze(np.minimum.reduceat(v, starts)), "hi": rtree._squeeze(np.maximum.reduceat(v, starts))}
    return rtree.Tree(row, x.shape[1], queries)


def test_boxes_bound_their_rows_and_prune():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((1, 4)) * 20 + rng.standard_normal((500, 4)) for _ in range(16)])
    labels = [int(k) for k in rng.integers(0, 2, len(x))]
    queries = rtree.whole(rng.standard_normal((20, 4)))
    tree = tree_of(x, labels, queries)
    assert (np.diff(tree.ends, prepend=0) <= rtree.LEAF).all() and tree.ends[-1] == len(x)
    bounds = tree.intervals(queries)
    exact = queries @ tree.x.T
    assert (bounds[0][0] <= np.minimum.reduceat(exact, tree.starts, 1)).all() and (bounds[0][1] >= np.maximum.reduceat(exact, tree.starts, 1)).all()
    opened = 0
    for i, q in enumerate(queries):
        mine = [(lo[i], hi[i]) for lo, hi in bounds]
        found, n = tree.best(mine, q, {}, 1, True, -1, 5)
        want = sorted(((-exact[i][p], tree.ids[p]) for p in range(len(x)) if tree.labels[p] == 1))[:5]
        assert [(-s, tree.ids[p]) for p, s in found] == want
        opened += n
        top = int(-want[0][0])
        if top > 0:
            least, greatest = rtree.window_of(top)
            found, _ = tree.best(mine, q, {}, 1, False, -1, 10, least, greatest)
            want = sorted(((-exact[i][p], tree.ids[p]) for p in range(len(x)) if tree.labels[p] == 0 and least <= exact[i][p] <= greatest))[:10]
            assert [(-s, tree.ids[p]) for p, s in found] == want
    assert opened < 0.25 * len(queries) * len(tree.ends)  # most boxes are never opened
