"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Every word has two forms, its bytes and its shape (letters A or a, digits 0,
other bytes as they are, runs collapsed; a repeated word has a shape of its
own).  Single forms and pairs of neighbouring forms are hashed into one weight
table; a text's vector holds their relative frequencies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (_BYTE, gram_hash, mix, powers, prefix_hash, slice_hash, stage_table, text_chunks, word_spans)

BITS = 18
SCALE = 20.0
SAMPLE_ROWS = 8000   # labelled rows that training uses at most (smallest seeded hashes)
LEARNERS = 4         # parts of the sample that learn on their own before weights are averaged
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def _shapes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    kind = _CLASS[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[s] = True
    at = np.cumsum(keep)                     # kept bytes up to and including each one
    p, inv = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        h = np.r_[np.uint64(0), np.cumsum(np.where(keep, _BYTE[kind] * p[at - 1], np.uint64(0)))]
        return mix((h[e] - h[s]) * inv[at[s] - 1] + np.uint64(1))


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the text, weight index) of all its features."""
    s, e, per = word_spans(buf, off)
    doc = np.repeat(np.arange(len(per)), per)
    if len(s) == 0:
        return doc, np.zeros(0, np.int64)
    words = slice_hash(prefix_hash(buf), s, e)
    shapes = _shapes(buf, s, e)
    near = doc[1:] == doc[:-1]
    again = np.r_[False, (words[1:] == words[:-1]) & near]
    shapes[again] = np.uint64(7)
    rows, found = [], []
    for salt, form in ((1, words), (2, shapes)):
        with np.errstate(over="ignore"):
            rows += [doc, doc[1:][near]]
            found += [mix(form + np.uint64(salt)), mix(gram_hash(form, 2)[near] + np.uint64(salt))]
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (indices, values, label) rows; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def _vectors(batches):
    for b in batches:
        for a, buf, off in text_chunks(b.column("text")):
            m = len(off) - 1
            row, at = features(buf, off)
            key, times = np.unique(row << BITS | at, return_counts=True)
            row, at = key >> BITS, key & ((1 << BITS) - 1)
            total = np.maximum(np.bincount(row, times, m), 1)
            value = SCALE * times / total[row]
            cut = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
            part = b.slice(a, m)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(cut, at.astype(np.int32)),
                 pa.ListArray.from_arrays(cut, value)], ["doc_id", "label", "at", "value"])


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(np.r_[a, 1 << BITS], np.r_[v, 1.0], float(y))
            for a, v, y in pdf.sort_values("turn")[["at", "value", "label"]].itertuples(index=False)]
    w = train_ftrl(rows)
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at.astype(np.int64), "weight": w[at]})


def fold(doc_id, parts: int = 3):
    """crc32 of the doc_id's text modulo ``parts``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Weight table from labelled documents outside the held-out fold.

    At most ``sample`` labelled rows (those with the smallest hashes) are
    fitted; their ids are a bounded broadcast.  A document labelled more than
    once has its mean label; null labels and ids are left out; labels without a
    document, or of one class only, are no error.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != held_out)
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
              .withColumn("turn", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("turn", "doc_id").limit(sample))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    vectors = stage_table(texts.mapInArrow(_vectors, "doc_id long, label double, at array<int>, value array<double>"), "vectors")
    parts = vectors.withColumn("turn", F.xxhash64(F.lit("turn"), "doc_id")).withColumn("part", F.pmod("turn", F.lit(LEARNERS)))
    learnt = parts.groupBy("part").applyInPandas(_learn, "at long, weight double")
    table = np.zeros((1 << BITS) + 1)
    for r in learnt.groupBy("at").agg(F.sum("weight").alias("w")).collect():  # a row per weight at most
        table[r["at"]] = r["w"] / LEARNERS
    return table


def score(docs: DataFrame, table: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) as column ``name``, which
    ``docs`` mustn't have; a null or blank text scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))
    text = docs.columns.index("text")

    def run(batches):
        w = shared.value
        for b in batches:
            out = []
            for _, buf, off in text_chunks(b.column(text)):
                m = len(off) - 1
                row, at = features(buf, off)
                dot = np.bincount(row, w[at], m) * SCALE / np.maximum(np.bincount(row, minlength=m), 1)
                out.append(1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *out]))],
                                             [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns as they are."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name).where(F.col(name) >= least).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, ...).

    Repeated rows score alike.  With no labelled row every score is 0.5.
    Only the text is an input of a score; other columns are ignored.
    """
    table = train(docs, labels)
    rows = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), table)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
