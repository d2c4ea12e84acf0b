"""Operators on documents against plain versions on a small table with nulls,
blank and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from demandlab.llm import bpe, common, fingerprint, mixing, ngram_lm, partenum, quality, secret_scan
from demandlab.llm.common import Stages, shingle_sets, text_chunks

from .conftest import LOWER, words


def components(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, doc_rows, size, percent):
    rows = sorted((r for r in doc_rows if r[0] is not None), key=lambda r: r[0])
    sets = [shingles(r[1], size) for r in rows]
    root = components(sets, lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    want = Counter((r[0], len(s), rows[k][0]) for r, s, k in zip(rows, sets, root))
    want.update((None, len(shingles(r[1], size)), None) for r in doc_rows if r[0] is None)
    assert Counter(map(tuple, partenum.jaccard_components(docs, size, percent).collect())) == want


def test_one_of_each_goes_by_rows(spark):
    """Several texts under one doc_id: each is kept or dropped for itself."""
    a = " ".join(f"w{i}" for i in range(100))
    near, other = a + " end", " ".join(f"v{i}" for i in range(50))
    rows = [(1, a), (5, near), (5, other), (7, other), (3, a), (3, a), (9, None), (9, None), (9, " "), (None, a), (None, a)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, component_id int")
    kept = partenum.one_of_each(table)
    assert kept.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (5, other), (9, None), (9, " "), (None, a)])


def test_jaccard_chain_through_middle(spark):
    """Ends of a chain link only through its middle; a hot group of copies stays one node."""
    base = [f"w{i}" for i in range(100)]
    a, b, c = list(base), list(base), list(base)
    b[10] = "x"
    c[10], c[60] = "x", "y"
    rows = [(1, " ".join(c)), (2, " ".join(b)), (3, " ".join(a))] + [(10 + i, " ".join(a)) for i in range(300)]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 94).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 303


def test_jaccard_large_family(spark):
    """A family larger than a cell's block, most members below the threshold to each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            w[p] = f"v{int(rng.integers(0, 30))}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 3) for _, t in rows]
    root = components(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_family_of_a_common_passage_is_cut(spark, monkeypatch, tmp_path):
    """Texts that share a passage meet only if they share a rare shingle as well, as all similar ones do."""
    monkeypatch.setattr(partenum, "CELL_ROWS", 20)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"w{x}" for x in rng.integers(0, 10 ** 6, 60)] for _ in range(70)]
    for i in range(0, 70, 7):  # similar ones
        texts.append([*texts[i][:115], *(f"x{i}-{k}" for k in range(5))])
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "set_key long, text string")
    members = table.selectExpr("set_key + 1000 AS node", "set_key", "set_key AS comp")
    edges = members.selectExpr("1000L AS a", "node AS b")
    got = {r.node - 1000: r.component for r in partenum._families(edges, members, table, 5, 80, Stages(spark)).collect()}
    assert all(got[i] == got[70 + i // 7] for i in range(0, 70, 7))
    assert max(Counter(got.values()).values()) < 10  # they were one family of 80
    sets = [shingles(" ".join(t), 5) for t in texts]
    root = components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    found = partenum.jaccard_components(table.withColumnRenamed("set_key", "doc_id"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))


def test_jaccard_tables_and_shuffles_go(spark, docs, monkeypatch, tmp_path):
    """Signatures, texts and links are deleted before the result is read; none is dealt in one piece."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    written = []
    table = Stages.table
    monkeypatch.setattr(Stages, "table", lambda self, df, name: written.append(name) or table(self, df, name))
    out = partenum.one_of_each(docs)
    assert {re.match("llm-([a-z]+)", p.name)[1] for p in tmp_path.iterdir()} <= {"sets", "components", "stars", "kept"}
    assert out.count() and sum(n.startswith("groups") for n in written) == partenum.SIGN_PARTS


def test_shingle_sets_are_sorted_and_distinct():
    text = pa.array(["a b a b a b a", "", "one", "b a b a b a b a"])
    (_, buf, off), = text_chunks(text)
    sets, sizes = shingle_sets(buf, off, 2)
    assert sizes.tolist() == [2, 0, 1, 2]
    assert all((np.diff(x.astype(np.int64)) > 0).all() for x in np.split(sets, np.cumsum(sizes)[:-1]))
    assert sets[:2].tolist() == sets[3:].tolist()


def test_signatures_lose_no_pair():
    """Random pairs at the threshold always share a signature, for all sizes."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in [*range(1, 60), 100, 333, 1000]:
            a = [f"t{x}" for x in rng.integers(0, 10 ** 9, n)]
            b = list(a)
            for _ in range(n * (100 - percent) // 100):
                if rng.random() < .5:
                    b.pop(int(rng.integers(len(b))))
                else:
                    b.append(f"u{rng.integers(0, 10 ** 9)}")
            sa, sb = set(a), set(b)
            if 100 * len(sa & sb) < percent * len(sa | sb) or sa == sb:
                continue
            (_, buf, off), = text_chunks(pa.array([" ".join(a), " ".join(b)]))
            sets, sizes = shingle_sets(buf, off, 1)
            signed = [partenum.signatures(sets, sizes, percent, shift) for shift in (0, 1)]
            left, right = ({int(s) for sig, row, _ in signed for s in sig[row == side]} for side in (0, 1))
            assert len(left & right) >= min(least[side] for _, _, least in signed for side in (0, 1))
            assert left & right


def test_fingerprints(docs, doc_rows):
    order = sorted(doc_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    nexts = texts[1:] + texts[:1]
    edited = [t[:len(t) - len(t) // 3] + s[:len(t) // 3] for t, s in zip(texts, nexts)]
    lanes, changed = fingerprint.fingerprint_texts(texts), fingerprint.fingerprint_texts(edited)
    near, follow = fingerprint.likeness(lanes, changed), fingerprint.likeness(lanes, fingerprint.fingerprint_texts(nexts))
    want = Counter((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.to_text(a), fingerprint.to_text(b), float(x), float(y))
                   for r, t, e, a, b, x, y in zip(order, texts, edited, lanes, changed, near, follow))
    for buckets in (1, 7):
        assert Counter(map(tuple, fingerprint.edit_fingerprints(docs, buckets).collect())) == want
    assert near[[len(t) > 300 for t in texts]].min() > 0.4


def test_fingerprint_is_homomorphic():
    a, b, c = "first paragraph here", "second one", "third, a longer paragraph of text"
    f = lambda *p: fingerprint.fingerprint_texts(["\n".join(p)])
    assert (f(a, b, c) == f(c, a, b)).all() and not (f(a, b, b) == f(a, a, b)).all()
    assert (fingerprint.combine(f(a, b), plus=fingerprint.sketches([c.encode()])) == f(a, b, c)).all()
    assert (fingerprint.combine(f(a, b, c), minus=fingerprint.sketches([b.encode()])) == f(a, c)).all()
    assert fingerprint.likeness(f(""), f(""))[0] == 1 and fingerprint.likeness(f(""), f(a))[0] == 0


def test_fingerprints_tell_structured_texts_apart():
    """Texts on which a polynomial hash collides; lanes against a plain version."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    pairs = [(a, b), (a + "\n" + b, b + "\n" + b), (a[:2048], b[:2048]), ("x" + a, "x" + b)]
    r = random.Random(1)
    pairs += [(t, t[:k] + r.choice("cd") + t[k + 1:]) for t in ("ab" * r.randint(1, 900) for _ in range(200)) for k in [r.randrange(len(t))]]
    for x, y in pairs:
        p, q = fingerprint.fingerprint_texts([x, y])
        assert (p != q).any() and (p[:fingerprint.EXACT_LANES] != q[:fingerprint.EXACT_LANES]).sum() >= fingerprint.EXACT_LANES - 2
        for text, lanes in ((x, p), (y, q)):
            want = [0] * 32
            for line in text.encode().split(b"\n"):
                d = hashlib.blake2b(line, digest_size=64, person=b"paragraph").digest()
                d += hashlib.blake2b(d, digest_size=64, person=b"more lanes").digest()
                want = [(w + int.from_bytes(d[4 * i:4 * i + 4], "little")) % 2 ** 32 for i, w in enumerate(want)]
            assert lanes[:32].tolist() == want


def test_likeness_of_long_repetitions():
    """Lane sums beyond 2^15, 2^16 and 2^31 / 2^16 keep their sign and size."""
    for text in ("a" * 40_000, "a" * 65_544, "a" * 400_000, "the same passage again\n" * 100_000):
        cut = len(text) - len(text) // 3
        other = " ".join(f"w{i}" for i in range(len(text)))[:len(text) // 3]
        (a, b) = fingerprint.fingerprint_texts([text, text[:cut] + other])
        assert fingerprint.likeness(a[None], b[None])[0] > 0.9
        edited, lanes = fingerprint._edit([text], [other], a[None])
        assert (lanes == fingerprint.fingerprint_texts(edited)).all()


def test_mix(docs, doc_rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in doc_rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, stop = 1.5 * sum(sizes.values()), set()
    while True:
        unit = (goal - sum(2 * sizes[s] for s in stop)) / sum(weight[s] for s in names if s not in stop)
        more = {s for s in names if s not in stop and unit * weight[s] > 2 * sizes[s]}
        if not more:
            break
        stop |= more
    target = {s: 2 * sizes[s] if s in stop else unit * weight[s] for s in names}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, _ in doc_rows)
    assert all(r.taken <= 2 * r.size for r in got)
    want = {(sizes[s], round(target[s], 6)) for s in names}
    assert {(r.source_size, round(r.target, 6)) for r in got} == want
    by = defaultdict(int)
    for r in got:
        by[(r.source_size, round(r.target, 6))] += r.taken
    assert all(abs(by[k] - k[1]) <= 12 for k in by)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents_match_taken(docs, doc_rows):
    rows = mixing.mixed_documents(docs)
    texts = defaultdict(list)
    for i, t, _ in doc_rows:
        texts[i].append(t)
    assert rows.columns == docs.columns
    took = Counter()
    for r in rows.collect():
        took[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        assert any(r.text in (t or "") for t in texts[r.doc_id])  # parts are cut out of the text, white space and all
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +took == +want
    again = mixing.mixed_documents(docs.repartition(5))  # rows of one doc_id and size are told apart by their texts
    assert Counter((r.doc_id, r.text) for r in rows.collect()) == Counter((r.doc_id, r.text) for r in again.collect())


def test_apportion_equals_plain_sainte_lague(spark):
    rng = np.random.default_rng(2)
    shares = [float(x) for x in rng.integers(1, 10 ** 6, 40)] + [0.0, 3.0, 3.0]
    seats = 977
    rows = [(0, k, s, 10 ** 6, seats) for k, s in enumerate(shares)]
    got = mixing.apportion(spark.createDataFrame(rows, "all int, no long, share double, stock long, seats long"), ["all"], "no").collect()
    order = sorted(((-s / (2 * k + 1), n, k) for n, s in enumerate(shares) if s > 0 for k in range(seats)))[:seats]
    assert {r.no: r.quota for r in got} == {n: sum(o[1] == n for o in order) for n in range(len(shares))}


def test_quality(spark, docs):
    rows = [(i, ("Good plain words in a row " * 5 + f"n{i}") if i % 2 else ("BUY!! NOW!! $$$ " * 6 + f"n{i}")) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "text"), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, 0, 0), (None, 1, 0), (7, None, 0), (5000, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.97
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.limit(0)).collect())
    kept = quality.good_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_ignores_held_out_labels(spark):
    rows = [(i, f"w{i % 7} w{i % 5} text {i}") for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    kind = "doc_id long, quality int"
    one = quality.train(table, spark.createDataFrame([(i, i % 2) for i in range(120)], kind))
    two = quality.train(table, spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2) for i in range(120)], kind))
    assert (one == two).all() and one.any()


def test_lm_base_and_bounds(docs, doc_rows):
    token = [words((t or "").translate(LOWER)) + [None] for _, t, _ in doc_rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _, _ in doc_rows]
    count = Counter(w for t, h in zip(token, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6))
                   for r, h, t in zip(doc_rows, held, token))
    got = ngram_lm.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_walk_equals_plain_backoff(spark):
    """The score of every text equals a dictionary backoff model's, and every
    context's probabilities sum to one."""
    rows = [(i, " ".join(["a b c d", "b c a", "x y a b", "c c c a"][(i * 7 + j) % 4] for j in range(i % 9))) for i in range(80)]
    got = {r.doc_id: r.score for r in ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [words(t) + ["</s>"] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    c2 = Counter(g for t in train for g in zip(t, t[1:]))
    c3 = Counter(g for t in train for g in zip(t, t[1:], t[2:]))
    c2 = {g: c for g, c in c2.items() if c >= 2}
    c3 = {g: c for g, c in c3.items() if c >= 2}
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)

    def p2(a, w):
        arcs = {g[1]: (c + 2 * p1(g[1])) / (c1[a] + 2) for g, c in c2.items() if g[0] == a}
        if not arcs:
            return p1(w)
        return arcs.get(w) or p1(w) * (1 - sum(arcs.values())) / (1 - sum(map(p1, arcs)))

    def p3(a, b, w):
        arcs = {g[2]: (c + 2 * p2(b, g[2])) / (c2[a, b] + 2) for g, c in c3.items() if g[:2] == (a, b) and (a, b) in c2}
        if not arcs:
            return p2(b, w)
        return arcs.get(w) or p2(b, w) * (1 - sum(arcs.values())) / (1 - sum(p2(b, x) for x in arcs))

    assert c3
    for a, b in c2:  # every state's probabilities sum to one, whatever LEAST left out
        assert abs(sum(p3(a, b, w) for w in [*c1, "unseen"]) - 1) < 1e-9
    for i, t in rows:
        t = words(t) + ["</s>"]
        plain = sum(math.log10(p1(t[k]) if k == 0 else p2(t[0], t[1]) if k == 1 else p3(t[k - 2], t[k - 1], t[k])) for k in range(len(t)))
        assert got[i] == pytest.approx(plain, abs=1e-6)


def test_lm_counts_rare_ngrams(spark, monkeypatch):
    """An n-gram of rare tokens counts from its second occurrence on, however
    many tokens there are, also when its texts lie in other shards."""
    monkeypatch.setattr(ngram_lm, "SHARD_DOCS", 7)
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 500)
    fill = [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(500))) for i in range(100)]
    train = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    held = [i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = fill + [(i, "rare1 rare2 rare3") for i in train] + [(held[0], "rare1 rare2 rare3"), (held[1], "rare3 rare2 rare1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_lm.lm_scores(frame).collect()}
    c1 = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), "</s>"])
    n = sum(c1.values()) + len(c1) + 1
    assert got[held[0]].train_tokens == sum(c1.values())
    p = [(c1[w] + 1) / n for w in ("rare1", "rare2", "rare3", "</s>")]
    two = [(2 + 2 * x) / (2 + 2) for x in p]
    three = [(2 + 2 * x) / (2 + 2) for x in two]
    want = sum(map(math.log10, (p[0], two[1], three[2], three[3])))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith(("llm-shards-", "llm-counts-", "llm-contexts-"))]  # stages are deleted
    assert got[held[0]].score == pytest.approx(want, abs=1e-6) and got[held[1]].score < got[held[0]].score - 5


PATTERNS = {"assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def test_secret_spans(spark, docs):
    rng = np.random.default_rng(4)
    h = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, f"é say PassWord = '{h(18)}' and {h(40)} AKIA{''.join(rng.choice(list('ABCDEFGH234567'), 16))} end") for i in range(200)]
    rows += [(500, "token: token: abcdefghijk tokEn=short secret=secret=12345678 api_key:\"ABC.DEF-1\" ſecret=12345678"),
             (501, f"bare {h(18)} and plainwordswithoutdigits plainwordswithdigits12xyz {h(31)}G"), (502, None), (503, ""),
             (504, "AKIA" + "A" * 11 + " AKIAAKIAAKIAAKIA " + "f" * 31 + " " + "f" * 32), (505, rows[0][1]), (None, rows[1][1]),
             (506, "x" * 200000 + " password=abcdefgh " + "0" * 50)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        t, found = texts[r.doc_id], []
        for k, (kind, p) in enumerate(PATTERNS.items()):
            for m in re.finditer(p, t):
                if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                    found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        base = [x[2] for x in sorted(found)]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == base
    added = next(r.spans for r in got if r.doc_id == 501).split(",")
    assert "format:5:23" in added and not any(x.startswith("format:28:") or x.startswith("format:52:") for x in added)
    clean = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[502] is None and "AKIA" not in clean[0] and clean[0].startswith("é say [secret]")
    assert secret_scan.redact(docs).columns == docs.columns


def test_format_spans_beside_the_patterns(spark):
    """Planted credentials without a known name: all found, nothing else; a plain scorer agrees."""
    rng = np.random.default_rng(8)
    code = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, f"password={code(24)} then") for i in range(150)]
    frames = ["auth={} x", "see.{} x", "https://h.example/p/{}/q x", "sig:{}, x", '"{}" x', "{}", "k=v={}. x", "ends {}."]
    planted = [(1000 + i, frames[i % len(frames)], f"0a{code(10 + i % 20)}") for i in range(160)]
    clean = [(3000, "mail7.example.com wrote imrmkbe.14 and asfekfe.36 on 2024-05-06T10:11:12 of version1.2.3 in chapter12"),
             (3001, "letters only abcdefabcdef 1234567890123 étabc12345678 abc12345678é")]
    docs = spark.createDataFrame(rows + [(i, f.format(w)) for i, f, w in planted] + clean, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    for i, f, w in planted:
        at = f.index("{}")
        assert got[i] == f"format:{at}:{at + len(w)}"
    assert got[3000] == "" == got[3001]
    models = secret_scan.learn(docs)
    model, least = models[0]
    for w in (planted[0][2], "versionn12", "0123abcd4567"):
        q, mass = 0, 0.0
        for c in w:
            mass += math.log2((model.uses[q].get(c, 0) + secret_scan.UNSEEN) / (model.seen[q] + 66 * secret_scan.UNSEEN))
            q = model.next[q].get(c, 0)
        mass += math.log2((model.ends[q] + secret_scan.UNSEEN) / (model.seen[q] + 66 * secret_scan.UNSEEN))
        flagged = secret_scan.all_spans(f"a {w} b", models) == [(2, 3, 2 + len(w))]
        assert flagged == (len(models) == 1 and mass / (len(w) + 1) >= least)
    many = " ".join(f"token={code(12)} 0a{code(12)}" for _ in range(20000))
    start = time.perf_counter()
    assert len(secret_scan.all_spans(many, models)) == 40000 and time.perf_counter() - start < 10


def test_automaton_learns_format():
    rng = np.random.default_rng(6)
    words_ = ["SK-" + "".join(rng.choice(list("0123456789"), 20)) for _ in range(200)]
    (model, least), = secret_scan.infer({"a": words_, "b": words_[:5]})
    assert len(model.states) < 60
    assert model.likelihood("SK-" + "7" * 20) >= least > model.likelihood("qwertyuiopasdfghjklzx12")


def test_bpe_round_trip(docs, doc_rows):
    tiktoken = pytest.importorskip("tiktoken")
    tok = pytest.importorskip("public_tokenizers")
    path = tok.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.parse_ranks(open(path, "rb").read())
    plain = tiktoken.Encoding("plain", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in doc_rows:
        ids = plain.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip_digests(docs, path, tok.PATTERN).collect())) == want
    codec = bpe.Codec(ranks, tok.PATTERN)
    slots = [codec.hash.slot(k) for k in ranks]
    assert sorted(slots) == list(range(len(ranks))) and codec.hash.slot(b"no such entry here") == -1
    rng = np.random.default_rng(0)
    odd = ["a" * 3000, "<|endoftext|>", "\u0000￾", " \n\t  x", "".join(map(chr, rng.integers(32, 0x2FFF, 4000))), "don't I'LL 's 123456"]
    for t in odd:
        ids = codec.encode(t)
        assert plain.encode_ordinary(t) == np.frombuffer(ids, "<u4").tolist() and codec.decode(ids) == t.encode()
    table = bpe.encode(docs.select("doc_id", "text", "source"), path, tok.PATTERN)
    back = bpe.decode(table.where("doc_id = 2007"), path).first()
    assert bytes(back["bytes"]).decode() == "日本 テスト\n\n🙂 ok"


def test_empty_tables(spark, no_docs):
    tok = pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert partenum.jaccard_components(no_docs).count() == 0
    assert fingerprint.edit_fingerprints(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert ngram_lm.lm_scores(no_docs).count() == 0
    assert secret_scan.scan(no_docs).count() == 0
    assert bpe.round_trip_digests(no_docs, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN).count() == 0
