"""The pipeline against a plain version on given documents, and its stages' contracts."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from demandlab.llm import mixing, queries, quality, secret_scan
from demandlab.llm.common import read

from .conftest import LOWER, words

SF = "/root/testdata/sf0.001"


def test_stage_order_and_entry():
    import __spark_entry__ as entry
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_run_equals_plain_version(spark):
    tok = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    docs = read(spark, SF, "documents")
    table = quality.train(docs, read(spark, SF, "labels"))
    good = {r.doc_id: r for r in quality.score(docs, table).collect() if r.score >= 0.5}

    def grams(t):
        w = words(t.translate(LOWER))
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: grams(r.text) for i, r in good.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, j in {(a, b) for l in where.values() for a in l for b in l if a < b}:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    kept = [good[i] for i in sets if find(i) == i]
    kept_docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in kept], docs.schema)
    models = secret_scan.learn(kept_docs)

    def clean(t):
        for s, _, e in reversed(secret_scan.all_spans(t, models)):  # spans of these texts may nest, never cross
            t = t[:s] + "[secret]" + t[e:]
        return t

    clean_docs = spark.createDataFrame([(r.doc_id, r.text if not secret_scan.all_spans(r.text, models) else None, r.source) for r in kept],
                                       "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    redacted = {r.doc_id: r.text for r in secret_scan.redact(kept_docs).collect()}
    plain_spans = {r.doc_id for r in kept if not secret_scan.all_spans(r.text, models)}
    assert all(redacted[r.doc_id] == r.text for r in kept if r.doc_id in plain_spans)
    assert clean_docs.count() == len(kept)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark.createDataFrame(
        [(r.doc_id, redacted[r.doc_id], r.source) for r in kept], "doc_id long, text string, source string")).collect()}
    assert set(got) == {i for i, (_, t) in taken.items() if t}
    enc = tiktoken.Encoding("p", pat_str=tok.PATTERN, special_tokens={},
                            mergeable_ranks=__import__("demandlab.llm.bpe", fromlist=["x"]).parse_ranks(
                                open(tok.path("byte_bpe_multi_50k.tiktoken"), "rb").read()))
    rows = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        rows[r.doc_id].append(r)
    for i, (size, t) in taken.items():
        if t % size == 0 and t:  # whole rounds or a run that covers the text
            whole = hashlib.sha256(redacted[i].encode()).hexdigest()
            if all(r.decoded_sha256 == whole for r in rows[i]):
                assert len(rows[i]) == t // size
                assert all(r.n_tokens == len(enc.encode_ordinary(redacted[i])) for r in rows[i])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, SF)
        rows = out.collect()
        if name != "encoding":
            assert out.columns == table.columns
        if name == "near_duplicates" and rows:
            assert max(Counter((r.doc_id, r.text) for r in rows).values()) == 1
            assert {2000, 2001, 2002, None} <= {r.doc_id for r in rows}
        if name in ("secrets", "encoding"):
            assert len(rows) == table.count()
