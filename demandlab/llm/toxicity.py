"""Toxicity: Levenshtein automata intersected with a trie of toxic terms, and
scores of the context that tell quotation from abuse.

The lexicon is learnt from labelled texts: whole words, and stems that many
different words begin with, that occur in far more toxic than clean texts.
Scoring folds the words of a text (letter case, digits that stand for letters),
and walks the trie with the Levenshtein automaton of every word that can match;
so a misspelled term is found as a term at distance one or two.  Words known
from clean texts are no misspellings.  Around each hit a window of words and
the quotation marks of its line decide how much it counts.  A logistic
regression over a text's hits gives its score; it is fitted on hits of lexicons
learnt from other texts than those that it is fitted on.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans, stage_table, text_chunks
from .quality import fold

SAMPLE_ROWS = 20_000   # labelled rows that training uses at most (smallest seeded hashes)
STEM = (3, 10)         # characters of a stem
LEAST_TEXTS, LEAST_SHARE = 3, 0.005  # toxic texts that a term needs, and their share of all toxic texts
COMMON = 0.02          # share of toxic texts from which misspellings of a word are looked for
LEAST_ODDS = 2.0       # log odds that a term needs
TERMS = 2000           # terms of the lexicon at most (the strongest)
WINDOW = 8             # words to each side of a hit
QUOTE_BYTES = 200      # bytes to each side in which quotation marks are looked for
FAR = {1: 0.6, 2: 0.4} # weight of a misspelling by its distance
QUOTED, REPORTED, ADDRESSED = 0.3, 0.6, 1.25  # context factors

# fixed values: words that report speech or name a word, and words that address a reader
REPORTING = frozenset("""said says wrote writes quoted quotes quote called calls word words term insult insults slur slurs phrase
sagte sagt schrieb schreibt nannte wort dit disait écrit mot insulte dijo dice escribió llamó palabra insulto""".split())
ADDRESSING = frozenset("you your youre yours u ur du dich dein deine ihr euch tu toi ton vous votre tú ti usted eres vosotros".split())
# fixed values: typographic quotation marks, and digits that stand for letters
MARKS = "[“”„‟«»‹›]"
LEET = str.maketrans("0134578", "oleastb")

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True


# ---------------------------------------------------------------- lexicon
class Term(NamedTuple):
    text: str
    stem: bool      # words that begin with it match; else the word itself
    weight: float
    reach: int = 0  # distance at which a word is still found


def reach(length: int) -> int:
    """Distance at which a common whole word of this length is still found."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """A trie of terms; ``known``: words of clean texts beside a term, which are no misspellings."""

    def __init__(self, terms: list[Term], known: frozenset[str] = frozenset()):
        self.terms, self.known = terms, known
        self.children: list[dict[str, int]] = [{}]
        self.word: list[Term | None] = [None]
        self.far: list[int] = [0]  # greatest reach of a term below the node
        self.stems = {t.text: t.weight for t in terms if t.stem}
        for t in terms:
            if t.stem:
                continue
            node, path = 0, [0]
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.far.append(0)
                node = self.children[node][c]
                path.append(node)
            self.word[node] = t
            for n in path:
                self.far[n] = max(self.far[n], t.reach)
        # (least and most characters of a word, from where, how many, which slices): a word that no line fits matches no term
        lines: dict[tuple[int, int, int, int], set[str]] = {}
        for t in terms:
            n = len(t.text)
            if t.stem:
                lines.setdefault((n, 1 << 30, 0, n), set()).add(t.text)
                continue
            cut = [n * i // (t.reach + 1) for i in range(t.reach + 2)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):  # one of reach + 1 pieces is whole, shifted by reach at most
                piece, least, most = t.text[a:b], max(1, n - t.reach), n + t.reach
                if k == 0:
                    lines.setdefault((least, most, 0, b), set()).add(piece)
                elif k == t.reach:
                    lines.setdefault((least, most, a - n, b - a), set()).add(piece)
                else:
                    for at in range(max(0, a - t.reach), a + t.reach + 1):
                        lines.setdefault((least, most, at, b - a), set()).add(piece)
        self.lines = [(*k, pa.array(sorted(v), pa.large_string())) for k, v in sorted(lines.items())]
        self._memo: dict[str, tuple[float, int]] = {}

    def able(self, words: pa.Array) -> np.ndarray:
        """Places of the words that may match a term."""
        ok = np.zeros(len(words), bool)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for least, most, at, n, pieces in self.lines:
            rows = np.flatnonzero((size >= least) & (size <= most) & ~ok)
            if len(rows):
                some = words.take(pa.array(rows))
                part = pc.utf8_slice_codeunits(some, at, at + n if at >= 0 or at + n < 0 else None)
                ok[rows] = pc.is_in(part, pieces).to_numpy(zero_copy_only=False)
        return np.flatnonzero(ok)

    def best(self, word: str) -> tuple[float, int]:
        """(weight, distance) of the strongest term that the word matches; (0, 0) if none."""
        if word not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[word] = self._walk(word)
        return self._memo[word]

    def _walk(self, word: str) -> tuple[float, int]:
        found = max([(self.stems[word[:k]], 0) for k in range(STEM[0], STEM[1] + 1) if len(word) >= k and word[:k] in self.stems], default=(0.0, 0))
        # a state of the word's automaton: distances of the trie's path to each beginning of the word
        stack = [(0, list(range(len(word) + 1)))]
        while stack:
            node, state = stack.pop()
            term = self.word[node]
            if term is not None and state[-1] <= term.reach and (state[-1] == 0 or word not in self.known):
                found = max(found, (term.weight * FAR.get(state[-1], 1.0), -state[-1]))
            for c, child in self.children[node].items():
                after = [state[0] + 1]
                for j, x in enumerate(word):
                    after.append(min(after[j] + 1, state[j + 1] + 1, state[j] + (x != c)))
                if min(after) <= self.far[child]:
                    stack.append((child, after))
        return found[0], abs(found[1])


def choose(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms from (text, stem, toxic texts, clean texts): the strongest by the
    log-likelihood ratio, none of which is a beginning of another.  Of equal
    ones the whole word, then the longest, is taken.  Misspellings are looked
    for of whole words in ``COMMON`` of the toxic texts or more."""
    def g2(p: int, n: int) -> float:
        out, rows = 0.0, toxic + clean
        for a, total in ((p, toxic), (n, clean)):
            for have, share in ((a, (p + n) / rows), (total - a, 1 - (p + n) / rows)):
                if have and share:
                    out += have * math.log(have / (total * share))
        return 2 * out

    ranked = []
    for text, stem, p, n in counts:
        odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        if p >= max(LEAST_TEXTS, LEAST_SHARE * toxic) and odds >= LEAST_ODDS:
            ranked.append((-g2(p, n), stem, -len(text), text, odds, p))
    taken: list[Term] = []
    covered: set[str] = set()   # beginnings of taken terms
    chosen: set[str] = set()
    for _, stem, _, text, odds, p in sorted(ranked):
        if len(taken) == TERMS:
            break
        if text in covered or any(text[:k] in chosen for k in range(STEM[0], len(text) + 1)):
            continue
        taken.append(Term(text, stem, min(odds, 8.0), 0 if stem or p < COMMON * toxic else reach(len(text))))
        chosen.add(text)
        covered.update(text[:k] for k in range(STEM[0], len(text) + 1))
    return taken


# ---------------------------------------------------------------- texts
def prepared(column) -> pa.Array:
    """Texts in lower case with plain quotation marks; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), MARKS, '"')


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, where they begin and end, and words per text."""
    solid = _WORD[buf]
    s, e, per = spans(solid, off)
    ends = np.r_[np.int64(0), np.cumsum(e - s)]
    words = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[solid]))])
    return words, s, e, per


def folded(words: pa.Array) -> pa.Array:
    """Digits within words of letters as the letters they stand for."""
    mixed = pc.and_(pc.match_substring_regex(words, "[0134578]"), pc.match_substring_regex(words, "[a-z]{2}"))
    if not pc.any(mixed).as_py():
        return words
    return pa.array([w.translate(LEET) if m else w for w, m in zip(words.to_pylist(), mixed.to_pylist())], pa.large_string())


def context(before: str, after: str, near: list[str]) -> float:
    """How much a hit counts: ``before`` and ``after`` are the bytes of its line
    around it, ``near`` the words of its window."""
    factor = 1.0
    opened = before.count('"') % 2 == 1 or before.endswith(("'", "`"))
    if opened and re.search("[\"'`]", after):
        factor *= QUOTED
    if not REPORTING.isdisjoint(near):
        factor *= REPORTED
    if factor == 1.0 and not ADDRESSING.isdisjoint(near):
        factor = ADDRESSED
    return factor


def hits(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Per text: sum and largest of the hits' weights in their context, words."""
    words, s, e, per = words_of(buf, off)
    out = np.zeros((len(per), 3))
    out[:, 2] = per
    if not len(s):
        return out
    coded = pc.dictionary_encode(words)
    distinct = folded(coded.dictionary)
    able = lexicon.able(distinct)
    weight = np.zeros(len(distinct))
    weight[able] = [lexicon.best(w)[0] for w in distinct.take(pa.array(able)).to_pylist()]
    each = weight[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(per)), per)
    ends = np.cumsum(per)
    for i in np.flatnonzero(each).tolist():
        d = doc[i]
        first, last = max(i - WINDOW, ends[d] - per[d]), min(i + WINDOW + 1, ends[d])
        a, b = max(s[i] - QUOTE_BYTES, off[d]), min(e[i] + QUOTE_BYTES, off[d + 1])
        before = bytes(buf[a:s[i]]).decode("utf-8", "replace").rpartition("\n")[2]
        after = bytes(buf[e[i]:b]).decode("utf-8", "replace").partition("\n")[0]
        value = each[i] * context(before, after, words[first:last].to_pylist())
        out[d, 0] += value
        out[d, 1] = max(out[d, 1], value)
    return out


def vector(hit: np.ndarray) -> np.ndarray:
    """Inputs of the regression: constant, all hits, the strongest, hits by length."""
    return np.stack([np.ones(len(hit)), np.log1p(hit[:, 0]), hit[:, 1], np.log1p(1000 * hit[:, 0] / (hit[:, 2] + 20))], 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, weights of the hits not below zero."""
    w = np.zeros(x.shape[1])
    free = np.ones(len(w), bool)
    while True:
        w[~free] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            pull = np.where(np.arange(len(w)) > 0, ridge, 1e-6)
            g = x.T @ (p - y) + pull * w
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w = w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        low = free & (np.arange(len(w)) > 0) & (w < 0)
        if not low.any():
            return w
        free &= ~low


# ---------------------------------------------------------------- training
COUNT_KIND = "half int, text string, stem boolean, toxic long, clean long"


def _count_terms(batches):
    """Toxic and clean texts with each word and each beginning of a word."""
    for b in batches:
        column = prepared(b.column("text"))
        for a, buf, off in text_chunks(column):
            words, _, _, per = words_of(buf, off)
            coded = pc.dictionary_encode(words)
            distinct = folded(coded.dictionary)
            n = max(len(distinct), 1)
            pair = np.unique(np.repeat(np.arange(len(per)), per) * n + coded.indices.to_numpy()) if len(words) else np.zeros(0, np.int64)
            doc, word = pair // n, pair % n
            part = b.slice(a, len(per))
            label, half = part.column("label").to_numpy(), part.column("half").to_numpy()
            long_ = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
            for k in [0, *range(STEM[0], STEM[1] + 1)]:  # 0: whole words
                fits = (long_ >= max(k, STEM[0]) if k else (long_ >= STEM[0]) & (long_ <= 40))[word] if len(word) else np.zeros(0, bool)
                short = pc.dictionary_encode(pc.utf8_slice_codeunits(distinct, 0, k) if k else distinct)
                if not fits.any():
                    continue
                m = len(short.dictionary)
                key = np.unique(doc[fits] * m + short.indices.to_numpy()[word[fits]])
                d, t = key // m, key % m
                group = half[d] * m + t
                toxic = np.bincount(group, label[d], 2 * m).astype(np.int64)
                every = np.bincount(group, minlength=2 * m)
                some = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((some // m).astype(np.int32)), short.dictionary.take(pa.array(some % m)).cast(pa.string()),
                     pa.array(np.full(len(some), k > 0)), pa.array(toxic[some]), pa.array((every - toxic)[some])],
                    [c.split()[0] for c in COUNT_KIND.split(", ")])


def _known(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            words = b.column("text").cast(pa.large_string())
            near = [w for w in words.take(pa.array(lexicon.able(words))).to_pylist() if lexicon.best(w)[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["text"])
    return run


def _hits(lexicons):
    def run(batches):
        for b in batches:
            for a, buf, off in text_chunks(prepared(b.column("text"))):
                part = b.slice(a, len(off) - 1)
                half = part.column("half").to_numpy()
                found = np.zeros((part.num_rows, 3))
                for h in (0, 1):
                    if (half == h).any():
                        found[half == h] = hits(buf, off, lexicons[h])[half == h]
                yield pa.RecordBatch.from_arrays([part.column("label")] + [pa.array(c) for c in found.T], ["label", "total", "most", "words"])
    return run


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5, sample: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray] | None:
    """(lexicon, weights) from labelled documents outside the held-out fold; None
    without texts of both classes.

    At most ``sample`` labelled rows (those with the smallest hashes) are
    fitted; their ids are a bounded broadcast, and what reaches the driver is
    bounded by them too.  Equal texts count once.  A document labelled more than
    once has its mean label; null labels and ids are left out.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), parts) != held_out)
              .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("label"))
              .orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("key"), F.md5("text").alias("digest")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = stage_table(texts.select("text", "label", F.pmod("key", F.lit(2)).cast("int").alias("half")), "labelled")
    size = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(size.get((h, y), 0) for h in (0, 1)) for y in (1.0, 0.0))
    if not toxic or not clean:
        return None
    counts = stage_table(rows.mapInArrow(_count_terms, COUNT_KIND).groupBy("half", "text", "stem")
                         .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    both = counts.groupBy("text", "stem").agg(
        F.sum("toxic").alias("p"), F.sum("clean").alias("n"),
        *[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")])
    able = both.where((F.col("p") >= LEAST_TEXTS) & (F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1)) >= LEAST_ODDS - 1)).collect()
    whole = counts.where("NOT stem AND clean > 0").groupBy("text").agg(F.sum("clean").alias("n")).where("n >= 2").select("text")

    def learnt(p: str, n: str, positives: int, negatives: int) -> Lexicon:
        terms = choose([(r["text"], r["stem"], r[p], r[n]) for r in able], positives, negatives)
        near = whole.mapInArrow(_known(Lexicon(terms)), "text string").collect()  # words of the sample beside a term
        return Lexicon(terms, frozenset(r["text"] for r in near))

    other = [learnt(f"toxic{1 - h}", f"clean{1 - h}", size.get((1 - h, 1.0), 0), size.get((1 - h, 0.0), 0)) for h in (0, 1)]
    found = rows.mapInArrow(_hits(other), "label double, total double, most double, words double").toArrow()
    labelled = found.column("label").to_numpy()
    x = vector(np.stack([found.column(c).to_numpy() for c in ("total", "most", "words")], 1))
    return learnt("p", "n", toxic, clean), fit(x, labelled)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, ...).

    Learns from the rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as
    text) modulo ``parts`` isn't ``held_out``.  Only the text is an input of a
    score: null, empty and blank texts score by the constant alone, repeated
    rows score alike, very long texts are read whole.  Without labelled texts
    of both classes every score is 0.5.  Other columns are ignored.
    """
    model = train(docs, labels, held_out, parts)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0].terms, model[0].known, model[1]))

    def run(batches):
        lexicon = Lexicon(*shared.value[:2]) if shared.value else None
        for b in batches:
            out = [np.zeros(0)]
            for _, buf, off in text_chunks(prepared(b.column("text"))):
                out.append(1 / (1 + np.exp(-np.clip(vector(hits(buf, off, lexicon)) @ shared.value[2], -35, 35)))
                           if lexicon else np.full(len(off) - 1, 0.5))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
