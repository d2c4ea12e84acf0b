"""Secret scans: fixed patterns, and formats inferred from what they find.

The credentials that the patterns find are labelled examples of their kind.
For every kind, the prefix tree of a bounded sample becomes a probabilistic
automaton by merging states whose outgoing and final frequencies are
compatible (Hoeffding bounds, recursively).  Every other run of credential
characters, and its parts, is scored by its mean log-likelihood a character;
the second half of the sample sets the threshold.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

# fixed values: the patterns of the base kinds
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"(?<![\w+/.=-])[A-Za-z0-9+/_.=-]{8,}(?!\w)")  # between other characters, ends of the text, quotes, colons
PART = re.compile(r"[^./=]{8,}")
HINTS = ("passw", "secret", "token", "key")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
KINDS = ("assign", "access", "hex", "format")

SAMPLE = 600          # distinct credentials of a kind that the automata are inferred from
SHORTEST = 8          # characters of a candidate
LEAST_EXAMPLES = 40   # a kind with fewer has no automaton
MERGE_ALPHA, UNSEEN, MARGIN = 0.05, 0.02, 0.25


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


class Automaton:
    """Probabilistic automaton merged from the prefix tree of examples."""

    def __init__(self, examples: list[str], alpha: float = MERGE_ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.uses: list[dict[str, int]] = [{}]
        for word in examples:
            q = 0
            self.seen[0] += 1
            for c in word:
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    for column, empty in ((self.next, {}), (self.uses, {})):
                        column.append(dict(empty))
                    self.seen.append(0)
                    self.ends.append(0)
                self.uses[q][c] = self.uses[q].get(c, 0) + 1
                q = self.next[q][c]
                self.seen[q] += 1
            self.ends[q] += 1
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n1, n2 = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in sorted({*self.uses[a], *self.uses[b]}):
                if self._differ(self.uses[a].get(c, 0), n1, self.uses[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds tree state b and what hangs below it to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, q in self.next[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + self.uses[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            fringe = [(-self.seen[q], r, c, q) for r in kept for c, q in self.next[r].items() if q not in kept]
            if not fringe:
                break
            _, r, c, q = min(fringe)
            for target in kept:
                if self._compatible(target, q):
                    self.next[r][c] = target
                    self._fold(target, q)
                    break
            else:
                kept.append(q)
        self.states = kept

    def likelihood(self, word: str) -> float:
        """Mean log2-likelihood a character of the whole word and its end."""
        q, total = 0, 0.0
        for c in word:
            total += math.log2((self.uses[q].get(c, 0) + UNSEEN) / (self.seen[q] + 66 * UNSEEN))
            q = self.next[q].get(c, 0)
        total += math.log2((self.ends[q] + UNSEEN) / (self.seen[q] + 66 * UNSEEN))
        return total / (len(word) + 1)


def infer(examples: dict[str, list[str]]) -> list[tuple[Automaton, float]]:
    """An automaton and a threshold for each kind with enough examples."""
    models = []
    for kind in sorted(examples):
        words = examples[kind]
        if len(words) < LEAST_EXAMPLES:
            continue
        model = Automaton(words[::2])
        likely = sorted(model.likelihood(w) for w in words[1::2])
        models.append((model, likely[len(likely) // 50] - MARGIN))
    return models


def candidates(run: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a credential in a run of credential
    characters: the whole run first, then its parts between stops, slashes and
    equals signs, each without signs around it, if they have ``SHORTEST``
    characters, a letter and a digit."""
    places = {}
    for a, b, signs in [(0, len(run), "./-_"), *((m.start(), m.end(), "-_") for m in PART.finditer(run))]:
        word = run[a:b]
        a, b = a + len(word) - len(word.lstrip(signs)), b - len(word) + len(word.rstrip(signs))
        if b - a >= SHORTEST and _DIGIT.search(run, a, b) and _LETTER.search(run, a, b):
            places[a, b] = None
    return list(places)


def all_spans(text: str, models: list[tuple[Automaton, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end): the base spans, and candidates beside them whose
    format an automaton accepts.  Of a run the parts accepted count; the whole
    run only if none is."""
    spans = [x[:3] for x in base_spans(text)]
    if models:
        ends, far = [], 0  # ends of the base spans up to each, which are in order of their starts
        for _, _, e in spans:
            far = max(far, e)
            ends.append(far)
        starts = [s for s, _, _ in spans]
        for m in RUN.finditer(text):
            accepted = []
            for a, b in candidates(m[0]):
                before = bisect.bisect_left(starts, m.start() + b)
                if before and ends[before - 1] > m.start() + a:
                    continue
                word = m[0][a:b]
                if any(model.likelihood(word) >= least for model, least in models):
                    accepted.append((a, b))
            if len(accepted) > 1 and accepted[0][0] <= accepted[1][0] and accepted[1][1] <= accepted[0][1]:
                del accepted[0]  # the whole run: parts of a run don't overlap
            spans += [(m.start() + a, 3, m.start() + b) for a, b in accepted]
    return sorted(spans)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _examples(batches):
    """The distinct credentials with the smallest hashes of each kind."""
    best: list[dict[str, int]] = [{}, {}, {}]
    for b in batches:
        for t in b.column("text").to_pylist():
            for _, kind, _, word in base_spans(t or ""):
                best[kind].setdefault(word, xxhash.xxh3_64_intdigest(word) >> 1)
        for k, d in enumerate(best):
            if len(d) > 4 * SAMPLE:
                best[k] = dict(heapq.nsmallest(SAMPLE, d.items(), key=lambda x: (x[1], x[0])))
    rows = [(KINDS[k], w, h) for k, d in enumerate(best) for w, h in heapq.nsmallest(SAMPLE, d.items(), key=lambda x: (x[1], x[0]))]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                      pa.array([r[2] for r in rows], pa.int64())], ["kind", "word", "place"])


def learn(docs: DataFrame) -> list[tuple[Automaton, float]]:
    """Automata from ``SAMPLE`` credentials of each kind at most."""
    found = stage_table(docs.select(F.col("text").cast("string").alias("text"))
                        .mapInArrow(_examples, "kind string, word string, place long"), "credentials").distinct()
    examples = {k: [r.word for r in found.where(F.col("kind") == k).orderBy("place", "word").limit(SAMPLE).collect()]
                for k in KINDS[:3]}
    return infer(examples)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, one row per input row.

    Offsets count code points.  Null texts are empty and have no span.
    Repeated rows are scanned alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        models = shared.value
        for b in batches:
            counts, shas, spans = [], [], []
            for t in b.column("text").to_pylist():
                found = all_spans(t or "", models)
                base = [x for x in found if x[1] < 3]
                counts.append([sum(x[1] == k for x in base) for k in range(3)])
                shas.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; n_chars, if
    there, is the new length.  Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def clean(text: str, models) -> str:
        out, at = [], 0
        for s, _, e in all_spans(text, models):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches):
        for b in batches:
            texts = [None if t is None else clean(t, shared.value) for t in b.column("text").to_pylist()]
            new = {"text": pa.array(texts, pa.string()),
                   "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else c for f, c in zip(b.schema, b.columns)],
                                             b.schema.names)

    return docs.mapInArrow(run, docs.schema)
