"""Shared helpers: stage tables in the cluster's shared folder and vectorised
word hashing over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20  # text bytes hashed at once; bounds the memory of a task
MASK52 = np.uint64((1 << 52) - 1)


# ---------------------------------------------------------------- tables
def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that task
    functions resolve where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a local
    session without that setting (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    a lost executor costs re-reading files instead of recomputing the stage."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Stage tables of one query, deleted as soon as nothing reads them any more.

    The files of a write's shuffles go when it ends: what follows reads the
    table.  ``keep`` names the tables that stay.
    """
    SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    @contextmanager
    def cleaning(self) -> Iterator[None]:
        """The shuffle files of what runs inside go when it ends."""
        before = self.spark.conf.get(self.SHUFFLES, "false")
        self.spark.conf.set(self.SHUFFLES, "true")
        try:
            yield
        finally:
            self.spark.conf.set(self.SHUFFLES, before)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with self.cleaning():
            self._paths[name] = f"{shared_dir(self.spark)}/llm-{name}-{uuid.uuid4().hex}"
            df.write.parquet(self._paths[name])
        return self.spark.read.schema(df.schema).parquet(self._paths[name])

    def close(self, keep: tuple[str, ...] = ()) -> None:
        """Delete the tables but those in ``keep``."""
        self.drop(*[n for n in self._paths if n not in keep])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# ---------------------------------------------------------------- hashing
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (kept per worker, grown on demand)."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        with np.errstate(over="ignore"):
            _POWERS["p"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
            _POWERS["i"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INV)])
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[0] = 0: the slice [s, e) hashes to (H[e] - H[s]) * base^-s."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * p[:-1], out=out[1:])
    return out


def slice_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64) * _GRAM[63])


def text_column(column) -> pa.Array:
    """A string column as large_string with nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_chunks(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about CHUNK_BYTES and at
    most 4096 rows each; a longer text forms a chunk of its own."""
    col = text_column(column)
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + CHUNK_BYTES, side="right")) - 1
        b = min(max(b, a + 1), n, a + 4096)
        yield a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def spans(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of solid bytes in each text: starts, ends and runs per text."""
    n = len(solid)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: starts, ends and words per text."""
    return spans(~SPACE[buf], off)


def gram_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += words[j:j + m] * _GRAM[j]
    return mix(out)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text (ASCII letters lower-cased): sorted
    52-bit hashes text after text, and the set sizes.  A text with fewer than
    ``size`` words has its whole sequence as its one shingle; none: empty."""
    low = LOWER[buf]
    s, e, per = word_spans(low, off)
    w = slice_hash(prefix_hash(low), s, e)
    docs = len(per)
    g = gram_hash(w, size)
    end = np.cumsum(per)
    doc = np.repeat(np.arange(docs), per)
    ok = np.arange(len(g)) + size <= end[doc[:len(g)]]
    owner, g = doc[:len(g)][ok], g[ok]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                has = per[short] > j
                at = (end[short] - per[short] + j)[has]
                extra[has] += w[at] * _GRAM[32 + j]
            extra = mix(extra + per[short].astype(np.uint64))
        owner, g = np.r_[owner, short], np.r_[g, extra]
    keyed = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (g >> np.uint64(12)))  # np.unique hashes: several times slower
    first = np.ones(len(keyed), bool)
    first[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[first]
    return keyed & MASK52, np.bincount((keyed >> np.uint64(52)).astype(np.int64), minlength=docs)


def set_sums(h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """Order-free 64-bit hash of the elements in each slot (0 elements: a constant)."""
    lo = np.bincount(slot, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), slots).astype(np.uint64)
    hi = np.bincount(slot, (h >> np.uint64(32)).astype(np.float64), slots).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(lo * _GRAM[61]) + hi * _GRAM[62])
