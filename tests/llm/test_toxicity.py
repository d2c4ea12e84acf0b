"""Toxicity: the automaton against plain edit distances, contexts, and a small
labelled corpus whose held-out rows must be told apart."""

import random
import zlib

import numpy as np
import pyarrow as pa

from demandlab.llm import toxicity
from demandlab.llm.toxicity import Lexicon, Term


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_walk_equals_plain_distances():
    r = random.Random(4)
    letters = "abcé"
    terms = {"".join(r.choice(letters) for _ in range(r.randint(3, 12))): r.random() < 0.2 for _ in range(60)}
    terms = [Term(t[:10] if stem else t, stem, 1 + r.random(), 0 if stem else toxicity.reach(len(t))) for t, stem in terms.items()]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    for t in terms:  # words beside the terms
        for _ in range(15):
            w = list(t.text) + (["a", "b"] if t.stem else [])
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(w) + 1)
                w[i:i + r.randint(0, 1)] = r.choice(["", *letters])
            words.append("".join(w) or "a")
    known = frozenset(words[::9])
    lexicon = Lexicon(terms, known)
    able = set(lexicon.able(pa.array(words, pa.large_string())).tolist())
    far = 0
    for k, w in enumerate(words):
        found = [(t.weight, 0) for t in terms if t.stem and w.startswith(t.text)]
        for t in terms:
            if not t.stem and (d := distance(t.text, w)) <= t.reach and (d == 0 or w not in known):
                found.append((t.weight * toxicity.FAR.get(d, 1.0), -d))
        weight, d = max(found, default=(0.0, 0))
        assert lexicon.best(w) == (weight, -d)
        assert k in able or not found
        far += d < 0
    assert far > 100


def weights(lexicon, text):
    column = toxicity.prepared(pa.array([text, None, ""]))
    off = np.frombuffer(column.buffers()[1], np.int64, 4, column.offset * 8)
    return toxicity.hits(np.frombuffer(column.buffers()[2], np.uint8), off, lexicon)


def test_context_and_spelling():
    lexicon = Lexicon([Term("wretch", False, 2.0, 1), Term("verm", True, 3.0)])
    plain = weights(lexicon, "that WRETCH came")
    assert plain[0].tolist() == [2.0, 2.0, 3.0] and plain[1].tolist() == plain[2].tolist() == [0, 0, 0]
    assert weights(lexicon, "a wre7ch and a wretsh")[0, 0] == 2.0 + 2.0 * toxicity.FAR[1]
    assert weights(lexicon, "vermin, verminous; averm")[0, 0] == 6.0
    assert weights(lexicon, "you wretch")[0, 0] == 2.0 * toxicity.ADDRESSED
    quoted = weights(lexicon, "he came in and read “wretch” aloud")[0, 0]
    assert quoted == 2.0 * toxicity.QUOTED
    assert weights(lexicon, 'the word "wretch" is old')[0, 0] == 2.0 * toxicity.QUOTED * toxicity.REPORTED
    assert weights(lexicon, 'an open " mark\nwretch " there')[0, 0] == 2.0  # marks of other lines don't count


def corpus(n=600, seed=6):
    r = random.Random(seed)
    syllables = ["ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "lé", "mi"]
    bad = ["wretch", "scoundrel", "verminous"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                term = r.choice([*bad, "xyl" + r.choice(syllables) + r.choice(syllables)])
                words.insert(r.randrange(len(words)), term if r.random() < 0.8 or len(term) < 6 else term[:3] + "q" + term[4:])
        docs.append((i, " ".join(words), int(not toxic)))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    return docs, labels


def test_scores_of_held_out_texts(spark):
    docs, labels = corpus()
    odd = [(9000, None, 0), (9001, "", 0), (9002, " \n ", 0), (None, "you scoundrel", 0), (9003, "co du wretch " * 30000, 1), docs[5], docs[5]]
    table = spark.createDataFrame([(*d, 0.5, "x", 1) for d in docs + odd], "doc_id long, text string, toxic int, score double, label string, half int")
    marks = spark.createDataFrame([(*x, 1) for x in labels + [(1, None), (None, 1), (77_777, 1), labels[0], (5, 1)]], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity_scores(table.repartition(3), marks).collect()
    assert len(rows) == len(docs) + len(odd)
    for x in rows:
        assert x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    got = {x.doc_id: x for x in rows}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held) and got[9003].predicted == 1
    assert len({got[i].score for i in (9000, 9001, 9002)}) == 1 and got[9000].predicted == 0


def test_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int")
    for marks in (none, one):
        rows = toxicity.toxicity_scores(docs, marks).collect()
        assert {r.score for r in rows} == {0.5} and len(rows) == docs.count()
    assert toxicity.toxicity_scores(no_docs, one).collect() == []
