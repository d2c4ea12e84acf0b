"""Ranked search against a plain version that scores every document."""

import math
import re
from collections import Counter

import numpy as np

from demandlab.llm import lexical

from .conftest import LOWER

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(rows, items, k):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, b in bags:
            n = sum(b.values())
            m = 50 + (50 * n * docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def items_of(rows):
    texts = [t for _, t, _ in rows if t]
    found = [(k, " ".join(t.split()[:12])) for k, t in enumerate(texts[:20])]
    found += [(100, None), (101, ""), (102, "!!! ..."), (103, "nowhereatall"), (104, "ONE, one; oNe"), (105, "日本 ok"), (None, texts[3][:40]),
              (106, texts[5]), (0, "two words"), found[2], found[2]]
    return found


def test_search_equals_plain_version(spark, docs, doc_rows, monkeypatch):
    items = items_of(doc_rows)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, query int")
    want = {k: plain_search([(i, t) for i, t, _ in doc_rows], items, k) for k in (3, 50, 1000)}
    for k in (3, 50, 1000):
        assert Counter(map(tuple, lexical.search(docs, table, k).collect())) == want[k]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)  # several blocks
    assert Counter(map(tuple, lexical.search(docs, table, 3).collect())) == want[3]


def test_search_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(no_docs, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ?")], "doc_id long, text string")
    assert lexical.search(blank, items).collect() == []


def test_ties_go_by_doc_id_across_partitions(spark):
    rows = [(i, "same words here") for i in range(500, 0, -1)] + [(None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "here same")], "item_id long, text string")
    got = lexical.search(docs.union(spark.createDataFrame([(9999, "other")], docs.schema)), items, 5).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 6)]


def test_accumulators_are_limited_and_survivors_exact():
    """Once k accumulators beat what the other terms can add, no more are created."""
    n = 10_000
    lists = [(np.arange(20), np.full(20, 900, np.int64)), (np.arange(0, n, 2), np.full(n // 2, 100, np.int64)),
             (np.arange(n), np.arange(n) % 7)]
    partial, live = np.zeros(n, np.int64), np.zeros(n, bool)
    made, created = lexical.best_documents(lists, np.array([900, 100, 6]), 10, partial, live)
    assert created == 20 and sorted(made.tolist()) == list(range(20))
    assert partial[made].tolist() == [900 + 100 * (d % 2 == 0) + d % 7 for d in made.tolist()]
    partial, live = np.zeros(n, np.int64), np.zeros(n, bool)
    made, created = lexical.best_documents(lists, np.array([900, 100, 6]), 21, partial, live)
    assert created == 20 + n // 2 - 10  # the last list adds at most 6, below the 21st score of 100


def test_terms_stay_inside_their_text():
    buf = np.frombuffer(b"abcDe f9\xc3\xa9", np.uint8)
    words, per = lexical.terms_of(buf, np.array([0, 3, 3, len(buf)]))
    assert words.to_pylist() == [b"abc", b"de", b"f9\xc3\xa9"] and per.tolist() == [1, 0, 2]
