"""Warehouse layout for co-located joins.

The ledger join (line items x orders on the order key) is the one join whose
both sides grow with the data.  Writing both tables bucketed (and sorted) by
the order key with the same bucket count lets Spark plan that sort-merge join
without any exchange: each task reads matching buckets of both tables.
Reading them back through the catalog (``Tables(spark, None, database)``)
keeps the bucket metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, table: str, keys, buckets: int, path: str | None = None,
                   sort: bool = True, fmt: str = "parquet") -> None:
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = df.write.mode("overwrite").format(fmt).bucketBy(buckets, *keys)
    if sort:
        w = w.sortBy(*keys)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(table)


def bucket_ledger(spark, src_root: str, database: str, buckets: int, path_root: str | None = None) -> None:
    """lineitem and orders bucketed by order key; dimensions copied as-is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    li = spark.read.parquet(f"{src_root}/lineitem.parquet")
    od = spark.read.parquet(f"{src_root}/orders.parquet")
    loc = (lambda n: f"{path_root.rstrip('/')}/{n}") if path_root else (lambda n: None)
    write_bucketed(li, f"{database}.lineitem", "l_orderkey", buckets, loc("lineitem"))
    write_bucketed(od, f"{database}.orders", "o_orderkey", buckets, loc("orders"))
    for name in ("customer", "part", "nation", "region"):
        w = spark.read.parquet(f"{src_root}/{name}.parquet").write.mode("overwrite")
        if path_root:
            w = w.option("path", loc(name))
        w.saveAsTable(f"{database}.{name}")
