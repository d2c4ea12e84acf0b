"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry as a whole is resolved by a minimal
perfect hash (one displacement per bucket, one slot per entry, key compared).
Any other pre-token is a doubly linked list of bytes whose neighbouring pairs
wait in a heap ordered by (rank, position); a pair that changed since it was
queued is skipped when it surfaces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000  # pre-tokens a worker remembers before it starts anew


def parse_ranks(rank_file: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x)}


class PerfectHash:
    """Minimal perfect hash of byte strings: len(keys) slots, each key its own.

    Keys fall into buckets; from the largest bucket on, the first displacement
    that sends all keys of a bucket to free slots is stored.  Buckets of one key
    come last and store their slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n = max(1, len(keys))
        self.buckets = max(1, -(-len(keys) // load))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots: list[bytes | None] = [None] * self.n
        groups: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh3_128_intdigest(k)
            groups[(h >> 96) % self.buckets].append((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, k))
        free = np.ones(self.n, bool)
        for b in sorted(range(self.buckets), key=lambda i: -len(groups[i])):
            if len(groups[b]) < 2:
                break
            f = np.array([x[0] for x in groups[b]], np.int64)
            g = np.array([x[1] | 1 for x in groups[b]], np.int64)
            for d0 in range(0, 1 << 30, 256):
                d = np.arange(d0, d0 + 256)[:, None]
                at = (f + d * g + (d * d) // 2) % self.n
                ok = free[at].all(1)
                ok &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if ok.any():
                    i = int(ok.argmax())
                    self.shift[b] = d0 + i
                    free[at[i]] = False
                    for s, x in zip(at[i].tolist(), groups[b]):
                        self.slots[s] = x[2]
                    break
        rest = iter(np.flatnonzero(free).tolist())
        for b, group in enumerate(groups):
            if len(group) == 1:
                s = next(rest)
                self.shift[b] = -1 - s
                self.slots[s] = group[0][2]
        self.shift = self.shift.tolist()

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 when it isn't one of the keys."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        s = -1 - d if d < 0 else ((h & 0xFFFFFFFF) + d * (((h >> 32) & 0xFFFFFFFF) | 1) + d * d // 2) % self.n
        return s if self.slots[s] == key else -1


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.id_of_slot = [ranks[k] if k is not None else -1 for k in self.hash.slots]
        self.byte_id = [ranks.get(bytes([x]), -1) for x in range(256)]
        self.joined = {ranks[t[:c]] << 32 | ranks[t[c:]]: r for t, r in ranks.items()
                       for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks}
        entries = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            entries[r] = t
        self.sizes = np.array([len(t) for t in entries], np.int64)
        self.starts = np.cumsum(np.r_[0, self.sizes])[:-1]
        self.letters = np.frombuffer(b"".join(entries), np.uint8)
        self.memo: dict[str, bytes] = {}

    def rank(self, piece: bytes) -> int:
        s = self.hash.slot(piece)
        return self.id_of_slot[s] if s >= 0 else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: lowest rank first, leftmost first."""
        n = len(piece)
        ids = [self.byte_id[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        join = self.joined.get
        heap = [(r, i, ids[i + 1]) for i in range(n - 1) if (r := join(ids[i] << 32 | ids[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[j] != right or join(ids[i] << 32 | right, -1) != r:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := join(r << 32 | ids[k], -1)) >= 0:
                    heapq.heappush(heap, (q, i, ids[k]))
            h = before[i]
            if h >= 0 and (q := join(ids[h] << 32 | r, -1)) >= 0:
                heapq.heappush(heap, (q, h, r))
        return [x for x in ids if x >= 0]

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode()
        r = self.rank(raw)
        return np.array([r] if r >= 0 else self.merge(raw), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        pieces = self.split(text)
        for p in set(pieces).difference(memo):
            memo[p] = self.piece_ids(p)
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.letters[np.arange(sizes.sum()) + np.repeat(self.starts[at] - ends + sizes, sizes)].tobytes()


_CODECS: dict[str, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = hashlib.sha1(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(rank_file), pattern)
    return _CODECS[key]


def _shared(spark: SparkSession, path: str):
    """The rank file's bytes as a broadcast: one vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Adds ``ids`` (array of int) to the rows; a null text counts as empty."""
    ranks = _shared(docs.sparkSession, rank_path)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            ids = [np.frombuffer(codec.encode(t or ""), "<i4") for t in b.column(b.num_columns - 1).to_pylist()]
            flat = np.concatenate([np.zeros(0, "<i4"), *ids])
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, flat)],
                                             [*b.schema.names[:-1], "ids"])

    keep = [c for c in docs.columns if c not in ("text", "ids")]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema] + ["ids array<int>"])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def decode(rows: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids array) -> (doc_id, bytes)."""
    ranks = _shared(rows.sparkSession, rank_path)

    def run(batches):
        codec = _codec(ranks.value, r"\S+")
        for b in batches:
            out = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256.

    Every whole text is encoded and its ids are decoded again.  A null text is
    empty (0 tokens); null doc_ids stay null; repeated rows are kept; other
    columns are ignored.  One row per input row, no shuffle.
    """
    ranks = _shared(docs.sparkSession, rank_path)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text"):
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
