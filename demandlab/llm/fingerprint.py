"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines).  Every paragraph hashes
to one wide vector; a document's fingerprint is the sum of the vectors of its
paragraphs, lane by lane modulo 2^32.  So it doesn't depend on their
order, and inserting or deleting a paragraph adds or subtracts one vector.

The vector has two parts.  32 lanes are the digest (BLAKE2, 1024 bits) of the
whole paragraph and tell multisets apart.  128 lanes sum signed
hashes of the paragraph's byte runs (a text has fewer than 2^31, so that no sum
wraps); they are short for like paragraphs, so
that the cosine of two documents' sums estimates how much they have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, prefix_hash, slice_hash

EXACT_LANES, LIKE_LANES, RUN = 32, 128, 9  # a run has so many bytes; a shorter paragraph is one run
WIDTH = EXACT_LANES + LIKE_LANES


def digest(paragraph: bytes) -> bytes:
    """As many independent bits as the exact lanes hold."""
    first = hashlib.blake2b(paragraph, digest_size=64, person=b"paragraph").digest()
    return first + hashlib.blake2b(first, digest_size=64, person=b"more lanes").digest()


def sketches(parts: Sequence[bytes]) -> np.ndarray:
    """One row of lanes (uint32) per item; each
    item is one or more paragraphs joined by line feeds."""
    out = np.zeros((len(parts), WIDTH), np.uint32)
    a = 0
    while a < len(parts):
        b, filled = a, 0
        while b < len(parts) and (b == a or filled + len(parts[b]) < CHUNK_BYTES):
            filled += len(parts[b])
            b += 1
        out[a:b] = _sketch_chunk(parts[a:b])
        a = b
    return out


def _sketch_chunk(parts: Sequence[bytes]) -> np.ndarray:
    n = len(parts)
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    stop = np.flatnonzero(buf == 10)                       # each paragraph's end
    start = np.r_[0, stop[:-1] + 1]
    last = np.cumsum([len(p) + 1 for p in parts]) - 1      # each item's last line feed
    first = np.r_[0, np.searchsorted(stop, last)[:-1] + 1]  # each item's first paragraph
    h = prefix_hash(buf)
    out = np.zeros((n, WIDTH), np.uint32)
    whole = np.frombuffer(b"".join(digest(p) for part in parts for p in part.split(b"\n")), "<u4").reshape(-1, EXACT_LANES)
    out[:, :EXACT_LANES] = np.add.reduceat(whole, first, 0)
    size = stop - start
    runs = np.where(size >= RUN, size - RUN + 1, size > 0)
    para = np.repeat(np.arange(len(start)), runs)
    at = start[para] + np.arange(len(para)) - np.repeat(np.cumsum(runs) - runs, runs)
    x = slice_hash(h, at, np.minimum(at + RUN, stop[para]))
    item = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    lane = item[para] * LIKE_LANES + (x & np.uint64(LIKE_LANES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((x >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    sums = np.bincount(lane, sign, n * LIKE_LANES).astype(np.int64).reshape(n, LIKE_LANES)
    out[:, EXACT_LANES:] = (sums % (1 << 32)).astype(np.uint32)
    return out


def combine(a: np.ndarray, plus: np.ndarray | None = None, minus: np.ndarray | None = None) -> np.ndarray:
    """Fingerprint lanes after inserting and deleting paragraphs."""
    out = a.copy()
    if plus is not None:
        out += plus
    if minus is not None:
        out -= minus
    return out


def to_text(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of lanes; 1 for equal fingerprints."""
    x = a[:, EXACT_LANES:].astype(np.int32).astype(np.float64)
    y = b[:, EXACT_LANES:].astype(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1.0), 0.0, 1.0)
    return np.where((a == b).all(1), 1.0, cos)


def fingerprint_texts(texts: Sequence[str]) -> np.ndarray:
    """Lanes of whole texts; an empty text has no paragraph and only zero lanes."""
    out = sketches([t.encode() for t in texts])
    out[[not t for t in texts]] = 0
    return out


def _edit(texts: list[str], nexts: list[str], lanes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Edited texts (their last third replaced by the start of the next text)
    and their lanes: the paragraphs from the cut on are deleted and inserted."""
    old, new, edited = [], [], []
    for t, s in zip(texts, nexts):
        k = len(t) // 3
        cut = len(t) - k
        e = t[:cut] + s[:k]
        begin = t.rfind("\n", 0, cut) + 1
        edited.append(e)
        old.append(t[begin:].encode())
        new.append(e[begin:].encode())
    out = combine(lanes, sketches(new), sketches(old))
    out[[not t for t in texts]] = 0
    return edited, out


KIND = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _run(batches):
    names = [x.split()[0] for x in KIND.split(", ")]
    held: list[tuple] = []  # (doc_id, text, lanes, next text, next lanes)
    bucket = first = open_row = None

    def flush():
        texts = [x[1] for x in held]
        lanes, following = np.stack([x[2] for x in held]), np.stack([x[4] for x in held])
        edited, changed = _edit(texts, [x[3] for x in held], lanes)
        columns = [pa.array([x[0] for x in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                   pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                   pa.array([to_text(v) for v in lanes], pa.string()), pa.array([to_text(v) for v in changed], pa.string()),
                   pa.array(likeness(lanes, changed)), pa.array(likeness(lanes, following))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            texts = [t or "" for t in part.column("text").to_pylist()]
            lanes = fingerprint_texts(texts)
            for k, (own, extra, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("bucket", "extra", "doc_id")))):
                row = (doc, texts[k], lanes[k])
                if own != bucket:
                    if open_row is not None:
                        held.append((*open_row, *first[1:]))
                    bucket, first, open_row = own, row, None
                if open_row is not None:
                    held.append((*open_row, *row[1:]))
                open_row = None if extra else row
            if held:
                yield flush()
    if open_row is not None:
        held.append((*open_row, *first[1:]))
        yield flush()


def edit_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, one row per input row.

    The next document is the one with the next smaller doc_id, after the last
    one the first.  Null texts are empty.  Rows of the same doc_id follow each
    other by text; rows with a null doc_id come last.  A single row is its own
    next document.  Other columns are ignored.

    Documents are cut into ranges of doc_id, and each range also gets the first
    document of the following one; texts are shuffled once, a range to a task.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (16 * n)) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)) if cuts else np.zeros(0)

    @F.pandas_udf("long")
    def bucket_of(doc_id: pd.Series) -> pd.Series:  # 0: the largest ids
        at = len(bounds) - np.searchsorted(bounds, doc_id.to_numpy(np.float64, na_value=-np.inf))
        return pd.Series(at)

    placed = docs.withColumn("bucket", bucket_of("doc_id"))
    # the largest doc_id of every range that has rows: as many values, and rows broadcast, as ranges
    tops = sorted(docs.select("doc_id", bucket_of("doc_id").alias("bucket")).groupBy("bucket")
                  .agg(F.max("doc_id").alias("top")).collect(), key=lambda r: r.bucket)
    tails = [(r.top, tops[i - 1].bucket) for i, r in enumerate(tops) if r.top is not None]
    extra = docs.join(F.broadcast(spark.createDataFrame(tails, "doc_id long, bucket long")), "doc_id")
    rows = (placed.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
            .repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text"))
    return rows.mapInArrow(_run, KIND)
