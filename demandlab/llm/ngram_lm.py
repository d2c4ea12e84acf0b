"""Language model scores by a weighted backoff automaton.

Every token's count takes part, and every run of up to ``ORDER`` tokens that
occurs ``LEAST`` times or more in the training documents, whatever its tokens,
is an arc.  A token, or a pair of tokens, with arcs is a state; its failure arc
carries the backoff weight that makes the probabilities of the state sum to
one and leads to the state of the shorter context, at last to the root, which
scores every token by its count.

Documents are packed into shards (distinct tokens and the sequence of their
places) once.  The model is never in one place: a shard asks for the counts of
its distinct n-grams (of three tokens, those whose two pairs are arcs), sorted by hash and cut into ranges of hashes (``part``);
every range sums what its shards sent and answers each in the order asked.  One
shard owns an n-gram and adds it to the sums of its context, which are summed
and answered alike.  So a shard gets the arcs and failure weights of its own
states, and its texts are walked from left to right (``walk``).

Bytes that move grow with the input; the number of rows they come in is shards
times ranges, so ``PART_TOKENS`` should grow with inputs beyond terabytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Stages, gram_hash, prefix_hash, slice_hash, text_chunks, word_spans
from .quality import fold

ORDER = 3             # tokens of the longest arc: a state remembers two
LEAST = 2             # fewest occurrences of an arc of two tokens or more; what rarer ones would get goes to the failure arc
MU = 2.0              # pseudo-counts of the shorter context's distribution
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 4000
PART_TOKENS = 1_000_000  # training and held-out tokens a range of hashes
END = np.uint64(0xE0D0E0D0E0D0E0D1)  # the end token

SHARD_KIND = "shard long, doc_id array<long>, held array<boolean>, lens array<int>, words binary, seq binary, size long, train long"
#: What a shard asks of a range of hashes (kind: tokens of an n-gram; values: its own sums), and the answer.
ASK_KIND = "part int, shard long, kind int, grams binary, values array<binary>"
ANSWER_KIND = "shard long, kind int, part int, values array<binary>, owned long"


def _pack(batches):
    """Shards of consecutive rows of a task."""
    zip_ = zstandard.ZstdCompressor(level=1)
    task, made = TaskContext.get().partitionId(), 0
    ids, held, lens, tokens, filled = [], [], [], [], 0

    def done():
        words, seq = np.unique(np.concatenate(tokens), return_inverse=True)
        train = int(np.array(lens)[~np.array(held, bool)].sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 24 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
             pa.array([lens], pa.list_(pa.int32())), pa.array([squeeze(np.diff(words, prepend=np.uint64(0)))], pa.binary()),
             pa.array([zip_.compress(np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())], pa.binary()), pa.array([len(seq)], pa.int64()),
             pa.array([train], pa.int64())],
            [x.split()[0] for x in SHARD_KIND.split(", ")])

    for b in batches:
        for a, buf, off in text_chunks(b.column("text")):
            low = LOWER[buf]
            s, e, per = word_spans(low, off)
            w = slice_hash(prefix_hash(low), s, e)
            part = b.slice(a, len(per))
            ids += part.column("doc_id").to_pylist()
            held += part.column("held").to_pylist()
            lens += (per + 1).tolist()
            tokens.append(np.insert(w, np.cumsum(per), END))
            filled += len(w) + len(per)
            if filled >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                yield done()
                made += 1
                ids, held, lens, tokens, filled = [], [], [], [], 0
    if ids:
        yield done()


def _unpack_seq(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def squeeze(v: np.ndarray) -> bytes:
    """Whole numbers, compressed: which of them aren't zero, and the planes of
    bytes of these."""
    v = v.astype("<u8")
    some = v != 0
    planes = np.ascontiguousarray(v[some].view(np.uint8).reshape(-1, 8).T)
    head = np.array([len(v), planes.shape[1]], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + np.packbits(some).tobytes() + planes.tobytes())


def spread(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, filled = np.frombuffer(data, "<u8", 2).tolist()
    some = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 16), count=n).astype(bool)
    out = np.zeros(n, "<u8")
    out[some] = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * filled, len(data) - 8 * filled).reshape(8, -1).T).view("<u8").ravel()
    return out


class Shard:
    """The distinct n-grams of a shard, sorted by hash, and where they stand."""

    def __init__(self, row: dict):
        self.words = np.cumsum(spread(row["words"]), dtype=np.uint64)  # sorted: their differences are shorter
        self.seq, self.lens = _unpack_seq(row["seq"]), np.array(row["lens"], np.int64)
        self.train = np.repeat(~np.array(row["held"], bool), self.lens)
        left = np.repeat(np.cumsum(self.lens), self.lens) - np.arange(len(self.seq))  # tokens of the text from here on
        x = self.words[self.seq]
        self.at, self.grams, self.which, self.some = {}, {1: self.words}, {1: self.seq}, {}
        for k in (2, 3):
            at = np.flatnonzero(left >= k).astype(np.int32)
            grams, some, which = np.unique(gram_hash(x, k)[at], return_index=True, return_inverse=True)
            self.at[k], self.grams[k], self.which[k], self.some[k] = at, grams, which.astype(np.int32), at[some]
        self.pair = np.zeros(len(self.seq), np.int32)  # number of the pair that begins here
        self.pair[self.at[2]] = self.which[2]

    def own_counts(self, k: int) -> np.ndarray:
        at = slice(None) if k == 1 else self.at[k]
        return np.bincount(self.which[k][self.train[at]], minlength=len(self.grams[k]))


def _asked(shard: int, kind: int, grams: np.ndarray, values: list[np.ndarray], parts: int):
    """A row for each range of hashes with n-grams."""
    place = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    part, first = np.unique(place, return_index=True)
    rows = [(int(p), squeeze(np.diff(grams[a:b], prepend=np.uint64(0))), [squeeze(v[a:b]) for v in values])
            for p, a, b in zip(part.tolist(), first.tolist(), [*first[1:].tolist(), len(grams)])]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()),
         pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))],
        [x.split()[0] for x in ASK_KIND.split(", ")])


def _answered(answers: pa.Table, kind: int, size: int, columns: int) -> list[np.ndarray]:
    """The answers to all that a shard asked of a kind, in the order of its n-grams."""
    rows = sorted((p, v) for k, p, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "values"))) if k == kind)
    out = [np.concatenate([spread(v[j]) for _, v in rows] or [np.zeros(0, np.uint64)]).astype(np.int64) for j in range(columns)]
    assert all(len(x) == size for x in out)
    return out


def _ask_counts(parts: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                for k in (1, 2):
                    yield _asked(row["shard"], k, s.grams[k], [s.own_counts(k)], parts)
    return run


def _answers():
    """Sums of a range of hashes, a row for each one asked.  Counts (kinds 1 to
    3) are 0 for an n-gram that isn't an arc, and have beside them 1 for its
    owner, the first shard that has it in a training text."""
    kind_ = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("values", pa.list_(pa.binary())),
                       ("owned", pa.int64())])

    def run(key, asked):
        out = []
        kinds = asked.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            rows = asked.filter(pa.array(kinds == kind)).sort_by("shard")
            grams = [np.cumsum(spread(g.as_py()), dtype=np.uint64) for g in rows.column("grams")]
            ends = np.cumsum([len(g) for g in grams])
            distinct, which = np.unique(np.concatenate(grams), return_inverse=True)
            del grams
            values = rows.column("values").to_pylist()
            sums, own = [], None
            for j in range(len(values[0])):
                v = np.concatenate([spread(x[j]) for x in values])
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, which, v.astype(np.int64))
                if kind <= 3:
                    have = np.flatnonzero(v)
                    owner = np.unique(which[have], return_index=True)[1]
                    total[total < (1 if kind == 1 else LEAST)] = 0
                    own = np.zeros(len(v), np.int64)
                    own[have[owner]] = 1
                    own[total[which] == 0] = 0
                sums.append(total)
            for i, shard in enumerate(rows.column("shard").to_pylist()):
                a, b = ends[i - 1] if i else 0, ends[i]
                answer = [squeeze(t[which[a:b]]) for t in sums] + ([squeeze(own[a:b])] if kind <= 3 else [])
                out.append((shard, kind, key[0].as_py(), answer, int(own[a:b].sum()) if kind <= 3 else 0))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), kind_)], schema=kind_) if out else kind_.empty_table()

    return run


def _counted(s: Shard, answers: pa.Table, sizes: tuple[int, ...] = (1, 2, 3), owners: bool = True):
    """Counts of the shard's n-grams by size, and which of them it owns."""
    c, own = {}, {}
    for k in sizes:
        may = _may_repeat(s, c[2]) if k == 3 else np.ones(len(s.grams[k]), bool)
        got = _answered(answers, k, int(may.sum()), 2 if owners else 1)
        c[k], own[k] = np.zeros(len(may), np.int64), np.zeros(len(may), bool)
        c[k][may] = got[0]
        if owners:
            own[k][may] = got[1] > 0
    return c, own


def _may_repeat(s: Shard, pairs: np.ndarray) -> np.ndarray:
    """Three tokens occur ``LEAST`` times only if both of their pairs do."""
    return (pairs[s.pair[s.some[3]]] > 0) & (pairs[s.pair[s.some[3] + 1]] > 0)


def _context_sums(s: Shard, c: dict, own: dict, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts of k tokens that may have arcs, and what the owned arcs add."""
    arcs = np.flatnonzero(own[k + 1])
    at = s.some[k + 1][arcs]
    context = s.seq[at] if k == 1 else s.pair[at]
    may, values = c[k] >= LEAST, []
    for v in [c[k + 1][arcs], c[1][s.seq[at + k]] + 1] + ([c[2][s.pair[at + 1]]] if k == 2 else []):
        total = np.zeros(len(may), np.int64)
        np.add.at(total, context, v)
        values.append(total[may])
    return s.grams[k][may], values


def _ask_again(parts: int, k: int):
    """Asks for the sums of the contexts of k tokens; with k = 1 also for the
    counts of three tokens."""
    kind = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("kind", pa.int32()), ("grams", pa.binary()),
                      ("values", pa.list_(pa.binary()))])

    def run(key, shards: pa.Table, answers: pa.Table) -> pa.Table:
        if shards.num_rows == 0:
            return kind.empty_table()
        row = shards.to_pylist()[0]
        s = Shard(row)
        c, own = _counted(s, answers, (1, 2) if k == 1 else (1, 2, 3))
        out = [_asked(row["shard"], 3 + k, *_context_sums(s, c, own, k), parts)]
        if k == 1:
            may = _may_repeat(s, c[2])
            out.append(_asked(row["shard"], 3, s.grams[3][may], [s.own_counts(3)[may]], parts))
        return pa.Table.from_batches(out, schema=kind)

    return run


def walk(s: Shard, arcs: dict, weights: dict, fails: dict) -> np.ndarray:
    """Log-probability of every token in one traversal of the shard's texts.

    The state before a token is what the last tokens of its text left behind: a
    pair, after the first token that token, at a text's beginning the root.  All
    traversals take their steps together: a token whose state has no arc for it
    adds the weight of the failure arc and is asked again in the shorter state;
    the root has an arc for every token.
    """
    n = len(s.seq)
    done = np.zeros(n)
    place = np.arange(n) - np.repeat(np.cumsum(s.lens) - s.lens, s.lens)  # tokens of the text before this one
    number = {}
    for k in range(2, ORDER + 1):  # the n-gram of k tokens that ends here
        number[k] = np.zeros(n, np.int64)
        number[k][s.at[k] + (k - 1)] = s.which[k]
    pending = np.arange(n)
    for k in range(ORDER, 1, -1):  # in states of k - 1 tokens
        here = pending[place[pending] >= k - 1]
        found = arcs[k][number[k][here]]
        taken, failed = here[found], here[~found]
        done[taken] += weights[k][number[k][taken]]
        state = s.seq[failed - 1] if k == 2 else number[k - 1][failed - 1]
        done[failed] += fails[k - 1][state]
        pending = np.r_[pending[place[pending] < k - 1], failed]
    done[pending] += weights[1][s.seq[pending]]
    return done


def _score(total: int, vocabulary: int):
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                      ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    every = total + vocabulary + 1

    def run(key, shards: pa.Table, answers: pa.Table) -> pa.Table:
        if shards.num_rows == 0:
            return kind.empty_table()
        s = Shard(shards.select(["words", "seq", "held", "lens"]).to_pylist()[0])
        c, _ = _counted(s, answers, owners=False)
        p1 = (c[1] + 1) / every
        # failure weights: what the arcs leave, over what the shorter context gives to all others
        weight = {}
        for k in (1, 2):
            may = np.flatnonzero(c[k] >= LEAST)
            sums = _answered(answers, 3 + k, len(may), k + 1)
            may, sums = may[sums[0] > 0], [v[sums[0] > 0] for v in sums]
            rest = (every - sums[1]) / every
            if k == 2:
                seen = c[1][s.seq[s.some[2][may] + 1]]
                rest = (seen - sums[2] + MU * rest) / (seen + MU)
            weight[k] = np.ones(len(c[k]))
            weight[k][may] = (c[k][may] - sums[0] + MU * rest) / ((c[k][may] + MU) * rest)
        # probabilities of the arcs; a longer one's rests on the shorter one's
        p, lower = {1: p1}, p1
        for k in range(2, ORDER + 1):
            at = s.some[k]
            context = s.seq[at] if k == 2 else s.pair[at]
            shorter = p1[s.seq[at + 1]] if k == 2 else lower[s.pair[at + 1]]
            p[k] = np.where(c[k] > 0, (c[k] + MU * shorter) / (c[k - 1][context] + MU), 0.0)
            lower = np.where(c[k] > 0, p[k], shorter * weight[k - 1][context])
        base = np.log10(p1)[s.seq]
        score = walk(s, {k: v > 0 for k, v in p.items()}, {k: np.log10(v, where=v > 0, out=np.zeros(len(v))) for k, v in p.items()},
                     {k: np.log10(v) for k, v in weight.items()})
        first = np.cumsum(s.lens) - s.lens
        hit = np.add.reduceat((c[1] > 0)[s.seq].astype(np.int64), first)
        row = {x: shards.column(x)[0] for x in ("doc_id", "held")}
        return pa.table([row["doc_id"].values, row["held"].values, pa.array(s.lens), pa.array(hit),
                         pa.array(np.full(len(s.lens), total, np.int64)), pa.array(np.add.reduceat(base, first)),
                         pa.array(np.add.reduceat(score, first))], schema=kind)

    return run


def lm_scores(docs: DataFrame, held_part: int = 2, parts: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, one row per input row.

    Learns from the rows whose crc32(doc_id as text) modulo ``parts`` isn't
    ``held_part``.  Null texts are empty: their one token is the end.  A null
    doc_id counts as empty text in the fold.  Repeated rows count as often as
    they occur.  Without a training row every base probability is 1.  Other
    columns are ignored.  Tokens and n-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (fold(F.col("doc_id"), parts) == held_part).alias("held"), F.col("text").cast("string").alias("text"))
    stages = Stages(spark)
    shards = stages.table(rows.mapInArrow(_pack, SHARD_KIND), "shards")
    sums = shards.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    total, ranges = int(sums["train"]), 1 + int(sums["size"]) // PART_TOKENS
    shards = shards.drop("size", "train")

    def answered(asked: DataFrame, name: str) -> DataFrame:
        return stages.table(asked.groupBy("part").applyInArrow(_answers(), ANSWER_KIND), name)

    bare = shards.drop("doc_id")
    known = answered(bare.mapInArrow(_ask_counts(ranges), ASK_KIND), "counts")
    size = int(known.where("kind = 1").agg(F.coalesce(F.sum("owned"), F.lit(0)).alias("n")).first()["n"])
    for k in (1, 2):
        asked = bare.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_ask_again(ranges, k), ASK_KIND)
        known = known.unionByName(answered(asked, f"contexts-{k}"))
    # scoring needs no owners
    known = known.select("shard", "kind", "part", F.when(F.col("kind") <= 3, F.slice("values", 1, 1)).otherwise(F.col("values")).alias("values"))
    scores = stages.table(shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
        _score(total, size), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    stages.close(keep=("scores",))
    return scores
