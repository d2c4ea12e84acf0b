"""Session helpers: recommended configuration, and the run that holds the
materialized shared intermediates.

Shared intermediates (the weekly fact, the modelling series, model outputs)
are written as parquet tables into the folder that the cluster names in
``spark.checkpoint.dir``: the lineage back to the ledger join is cut, a lost
executor only re-reads files, and later plans keep column pruning, filter
pushdown and file statistics.

A ``Run`` owns these tables.  Pass one to ``Tables`` for a pipeline run and
close it at the end (``with Run(spark) as run``); its folder is deleted then.
Without one, ``Tables`` uses the run of its input: the run is found by the
identity (path, size, modification time) of the input files, so changed input
gets a new run, and the run of the old files is closed.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "demandlab",
                  extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, only a local
    session (tests, bench) gets a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared (cluster-visible) directory")
        folder = tempfile.mkdtemp(prefix="demandlab-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Run:
    """Materialized tables of one run: built once per key, also under threads."""

    def __init__(self, spark: SparkSession, materialized: bool = True):
        self.spark, self.materialized = spark, materialized
        self.folder: str | None = None
        self._lock = threading.Lock()
        self._tables: dict[tuple, DataFrame] = {}
        self._building: dict[tuple, threading.Lock] = {}

    def table(self, key: tuple, build: Callable[[], DataFrame], partition_by=None) -> DataFrame:
        """The table of ``key``, built on first use; a plain lazy plan each time
        when the run was made with ``materialized=False``."""
        if not self.materialized:
            return build()
        with self._lock:
            building = self._building.setdefault(key, threading.Lock())
        with building:
            if key not in self._tables:
                self._tables[key] = self._write(build(), partition_by, str(key[0]))
            return self._tables[key]

    def _write(self, df: DataFrame, partition_by, name: str) -> DataFrame:
        with self._lock:
            if self.folder is None:
                self.folder = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/demandlab-run-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        if partition_by:  # later filters skip directories; ``build`` sees to it that few tasks write, no shuffle follows
            df.write.partitionBy(*partition_by).parquet(path)
        else:
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def close(self) -> None:
        """Forget and delete the run's tables; frames that still read them fail."""
        with self._lock:
            self._tables.clear()
            self._building.clear()
            folder, self.folder = self.folder, None
        if folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def input_identity(spark: SparkSession, paths: list[str]) -> tuple:
    """One row about the files below ``paths``: number and a hash of their paths,
    sizes and modification times.  Only file metadata is read."""
    row = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
           .agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())
    return (row[0], str(row[1]))


_RUNS_LOCK = threading.Lock()
_RUNS: dict[tuple, tuple[tuple, Run]] = {}  # (application, source) -> (identity, run): one run a source


def run_of_input(spark: SparkSession, source: tuple, identity: tuple) -> Run:
    """The run of these files; the run of the source's former files is closed."""
    key = (spark.sparkContext.applicationId, *source)
    with _RUNS_LOCK:
        known = _RUNS.get(key)
        if known is not None and known[0] == identity:
            return known[1]
        run = Run(spark)
        _RUNS[key] = (identity, run)
    if known is not None:
        known[1].close()
    return run


def close_runs() -> None:
    """Close every run that was found by its input."""
    with _RUNS_LOCK:
        runs = [r for _, r in _RUNS.values()]
        _RUNS.clear()
    for r in runs:
        r.close()


def shared(t, key: tuple, build: Callable[[], DataFrame], partition_by=None) -> DataFrame:
    """The table ``key`` of the run that ``t`` (a ``Tables``) belongs to."""
    return t.run.table(key, build, partition_by)
