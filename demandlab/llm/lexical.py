"""Ranked lexical search, term at a time with limited accumulators.

Tasks index their documents once, for the terms of the queries only: postings
by term, written as rows of a stage table.  The statistics of all documents
(how many, their terms, documents a term) are summed from these rows.  Every
index row then ranks its own documents for every query: terms from the rarest
on create accumulators until the most that the terms left can add is below the
kth best partial score; from then on only accumulators that exist are updated,
exactly.  The best of each index row are merged by a window in two steps.

Queries come in blocks of at most ``BLOCK_TERMS`` terms (one query at least), so
what the tasks get of them is bounded; every block reads all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, spans, stage_table, text_chunks

BLOCK_TERMS = 200_000        # terms of the queries that are handled at once
ROW_DOCS = 1 << 16           # documents of an index row at most
ROW_POSTINGS = 4_000_000     # and postings, but for a single document with more

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

INDEX_KIND = ("row long, ids binary, nulls binary, sizes binary, terms binary, counts binary, docs binary, tf binary, "
              "n_docs long, n_terms long")
FOUND_KIND = "query long, row long, doc_id long, score long"


def terms_of(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of each text (ASCII letters lower-cased) and how many a text has."""
    low = LOWER[buf]
    solid = _TERM[low]
    s, e, per = spans(solid, off)
    ends = np.r_[np.int64(0), np.cumsum(e - s)]
    values = np.ascontiguousarray(low[solid])
    return pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(values)]), per


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _index(terms: list[bytes]):
    """Index rows of a task's documents, for the given terms."""
    wanted = pa.array(terms, pa.large_binary())

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, nulls, sizes, term, doc, tf, filled, docs = [], [], [], [], [], [], 0, 0

        def done():
            t, d, f = np.concatenate(term), np.concatenate(doc), np.concatenate(tf)
            order = np.argsort(t, kind="stable")
            has, counts = np.unique(t, return_counts=True)
            n = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 24 | made], pa.int64())]
                + [pa.array([_squeeze(x)], pa.binary()) for x in (
                    np.concatenate(ids), np.concatenate(nulls), n, has.astype("<i4"), counts.astype("<i4"),
                    d[order].astype("<i4"), f[order].astype("<i8"))]
                + [pa.array([x], pa.int64()) for x in (int((n > 0).sum()), int(n.sum()))],
                [x.split()[0] for x in INDEX_KIND.split(", ")])

        for b in batches:
            column = b.column("doc_id")
            gone = pc.is_null(column).to_numpy(zero_copy_only=False)
            known = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            for a, buf, off in text_chunks(b.column("text")):
                words, per = terms_of(buf, off)
                at = pc.index_in(words, wanted)
                hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                owner = np.repeat(np.arange(len(per)), per)[hit]
                which = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                key, times = np.unique(owner * (len(terms) + 1) + which, return_counts=True)
                ids.append(known[a:a + len(per)].astype("<i8"))
                nulls.append(gone[a:a + len(per)])
                sizes.append(per.astype("<i8"))
                term.append(key % (len(terms) + 1))
                doc.append(key // (len(terms) + 1) + docs)
                tf.append(times)
                docs += len(per)
                filled += len(key)
                if docs >= ROW_DOCS or filled >= ROW_POSTINGS:
                    yield done()
                    made += 1
                    ids, nulls, sizes, term, doc, tf, filled, docs = [], [], [], [], [], [], 0, 0
        if docs:
            yield done()

    return run


def _frequencies(batches):
    for b in batches:
        for terms, counts in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_spread(terms, "<i4")), pa.array(_spread(counts, "<i4").astype(np.int64))],
                                             ["term", "df"])


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, k: int, partial: np.ndarray,
                   live: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that may be among the ``k`` best (their exact scores are left in
    ``partial``) and how many accumulators were created.

    ``lists``: (documents, what the term adds to each) from the rarest term on;
    ``most``: the largest addition of each list.  ``live`` is false everywhere,
    and ``partial`` is only valid where it is true; the caller clears both.
    """
    left = np.r_[np.cumsum(most[::-1])[::-1], 0]
    made, created, creating = [], 0, True
    for j, (docs, adds) in enumerate(lists):
        known = live[docs]
        partial[docs[known]] += adds[known]
        if creating:
            new = docs[~known]
            partial[new] = adds[~known]
            live[new] = True
            made.append(new)
            created += len(new)
            if created >= k:  # strictly below: a document that only ties may have the smaller id
                scores = partial[np.concatenate(made)]
                creating = left[j + 1] >= np.partition(scores, len(scores) - k)[len(scores) - k]
    return (np.concatenate(made) if made else np.zeros(0, np.int64)), created


def _rank(queries: list[tuple[int, np.ndarray]], weight: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The ``k`` best documents of an index row for every query."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, nulls, sizes = _spread(row["ids"], "<i8"), _spread(row["nulls"], "?"), _spread(row["sizes"], "<i8")
                has, counts = _spread(row["terms"], "<i4"), _spread(row["counts"], "<i4")
                docs, tf = _spread(row["docs"], "<i4").astype(np.int64), _spread(row["tf"], "<i8")
                m = 100 - 50 + (50 * sizes * n_docs) // max(n_terms, 1)
                adds = np.repeat(weight[has], counts) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
                ends = np.cumsum(counts)
                place = {t: i for i, t in enumerate(has.tolist())}
                most = np.maximum.reduceat(adds, ends - counts) if len(has) else adds
                partial, live = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                out = [[], [], [], []]
                for number, terms in queries:
                    mine = sorted((t for t in terms.tolist() if t in place), key=lambda t: (df[t], t))
                    at = np.array([place[t] for t in mine], np.int64)
                    lists = [(docs[ends[i] - counts[i]:ends[i]], adds[ends[i] - counts[i]:ends[i]]) for i in at]
                    made, _ = best_documents(lists, most[at], k, partial, live)
                    scores = partial[made]
                    live[made] = False
                    if len(made) > k:
                        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        made, scores = made[keep], scores[keep]
                    order = np.lexsort((ids[made], nulls[made], -scores))[:k]
                    order = order[scores[order] > 0]
                    out[0] += [number] * len(order)
                    out[1] += [row["row"]] * len(order)
                    out[2] += [None if nulls[d] else int(ids[d]) for d in made[order]]
                    out[3] += scores[order].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], [x.split()[0] for x in FOUND_KIND.split(", ")])

    return run


def _query_terms(batches):
    for b in batches:
        for a, buf, off in text_chunks(b.column("text")):
            words, per = terms_of(buf, off)
            cut = np.r_[0, np.cumsum(per)].tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").slice(a, len(per)),
                 pa.array([sorted(set(words[x:y].to_pylist())) for x, y in zip(cut, cut[1:])], pa.list_(pa.binary()))],
                ["item_id", "terms"])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, filled = [], 0
    for r in items.toLocalIterator():  # a partition at a time
        if block and filled + len(r["terms"]) > BLOCK_TERMS:
            yield block
            block, filled = [], 0
        block.append((r["item_id"], [bytes(t) for t in r["terms"]]))
        filled += len(r["terms"])
    if block:
        yield block


def _search_block(rows: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = rows.sparkSession
    terms = sorted({t for _, ts in block for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    queries = [(i, np.array([number[t] for t in ts], np.int64)) for i, (_, ts) in enumerate(block)]
    index = stage_table(rows.mapInArrow(_index(terms), INDEX_KIND), "postings")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t"),
                      F.count("*").alias("rows")).first()
    df = np.zeros(len(terms), np.int64)
    counted = index.select("terms", "counts").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.toLocalIterator():  # a row per term of the block at most
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total["d"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    found = index.mapInArrow(_rank(queries, weight, df, total["d"], total["t"], k), FOUND_KIND)
    best = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    last = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    parts = max(1, math.isqrt(total["rows"]))
    top = (found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("rank", best).where(F.col("rank") <= k)
           .withColumn("rank", last).where(F.col("rank") <= k))
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "query long, item_id long")  # the block's queries
    return top.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text, ...) for every row of
    ``items`` (item_id, text, ...) -> item_id, rank, doc_id, score.

    Terms are runs of ASCII letters (lower-cased), digits and all characters
    from U+0080 on.  With N documents that have a term, L terms in them, n terms
    in a document and df documents holding a term: w = floor(1000 ln((2N + 2) /
    (2 df + 1))), m = 50 + 50 n N div L, and a document's score is the sum of
    w * (10^9 tf div (1000 tf + 20 m)) over the distinct terms of the query.
    Only scores above 0 count; equal scores go by doc_id, null last.

    Null and empty texts have no terms: as queries they find nothing, as
    documents they aren't found.  Every row of ``docs`` is a document, repeated
    rows too; repeated rows of ``items`` count once, and different texts under
    one item_id are ranked each on its own.  A null item_id is kept.  Other
    columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    asked = stage_table(items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
                        .mapInArrow(_query_terms, "item_id long, terms array<binary>"), "queries")
    out = None
    for block in _blocks(asked):
        part = stage_table(_search_block(rows, block, k), "ranked")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SEARCH_SQL = r"""
WITH found AS (
  SELECT doc_id, row, term, count(*) AS tf FROM (
    SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents) x) y GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY row),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM found CROSS JOIN total GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT a.item_id, a.text, f.row, f.doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN found f USING (term) JOIN weights USING (term) JOIN sizes USING (row) CROSS JOIN total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""
