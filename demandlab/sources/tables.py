"""Warehouse table access.

``Tables`` is a lazy handle over a directory of parquet tables (one
``<name>.parquet`` per table) or, when ``root`` is None, over catalog tables
(``spark.table``).  Reading is lazy: nothing is scanned until an action, and
Catalyst prunes columns / pushes filters into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandlab.session import Run, input_identity, run_of_input


class Tables:
    """``run`` owns the materialized intermediates (see ``session.Run``).
    Without one, directories use the run of their files' identity, and catalog
    tables a run of this object alone."""

    LEDGER = ("region", "nation", "customer", "part", "orders", "lineitem")

    def __init__(self, spark: SparkSession, root: str | None = None, database: str | None = None, run: Run | None = None):
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.database = database
        self._run = run
        self._cache: dict[str, DataFrame] = {}

    @property
    def run(self) -> Run:
        if self._run is None:
            if self.root is None:
                self._run = Run(self.spark)
            else:
                identity = input_identity(self.spark, [f"{self.root}/{n}.parquet" for n in self.LEDGER])
                self._run = run_of_input(self.spark, (self.root,), identity)
        return self._run

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if self.root is not None:
                df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            else:
                qualified = f"{self.database}.{name}" if self.database else name
                df = self.spark.table(qualified)
            self._cache[name] = df
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table by (optionally qualified) name."""
    return spark.table(name)


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """Read by SQL text; the text is parsed and optimized by Catalyst."""
    return spark.sql(query)


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def strip_column_prefix(df: DataFrame, sep: str = ".") -> DataFrame:
    """Drop a ``table.`` prefix that some drivers prepend to column names."""
    return df.toDF(*[c.split(sep)[-1] for c in df.columns])
