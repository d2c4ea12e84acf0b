"""File sources: typed CSV, newest-file-in-directory, JSON series
flattening; and sinks (table overwrite, stage files, column contracts)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header.  Pass an explicit schema in production (no
    inference pass over the data); ``inferSchema`` is used only without one."""
    r = spark.read.option("header", "true")
    if schema is not None:
        # the header must carry the schema's names in its order, and every value its type
        return r.option("enforceSchema", "false").option("mode", "FAILFAST").options(**options).schema(schema).csv(path)
    return r.option("inferSchema", "true").options(**options).csv(path)


def newest_file(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """Path of the most recently modified file below ``path`` whose name matches
    ``pattern``; of files modified at the same time, the one with the largest
    path.  Only file metadata is read (no content), and one row comes back."""
    row = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
           .select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first())
    if row is None:
        raise FileNotFoundError(f"no file {pattern} below {path}")
    return row["path"]


def newest_drop(spark: SparkSession, directory: str, pattern: str = "*") -> str:
    """Path of the newest drop in ``directory``: a file in it, or a folder with
    files at any depth, whose names match ``pattern``.  A drop is as new as its
    most recently modified file; of equally new ones, the largest name counts.
    Only file metadata is read, and one row comes back."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", directory).rstrip("/") + "/"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
             .select("path", "modificationTime"))
    inside = F.substring(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base)), F.length("path"))
    row = (files.where(F.locate(base, F.col("path")) > 0).groupBy(F.split_part(inside, F.lit("/"), F.lit(1)).alias("drop"))
           .agg(F.max("modificationTime").alias("time")).orderBy(F.desc("time"), F.desc("drop")).limit(1).first())
    if row is None:
        raise FileNotFoundError(f"no file {pattern} below {directory}")
    return f"{directory.rstrip('/')}/{row['drop']}"


def latest_file_read(spark: SparkSession, directory: str, fmt: str = "csv",
                     schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Rows of the newest drop in ``directory`` (``newest_drop``): one file, or
    all files of one folder that match ``pattern``, read in parallel.  Files of
    older drops are never opened."""
    pattern = options.pop("pattern", "*")
    path = newest_drop(spark, directory, pattern)
    options |= {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    r = spark.read.options(**options)
    return (r.schema(schema) if schema is not None else r).format(fmt).load(path)


def read_two_row_header(spark: SparkSession, path: str, id_columns: int, value_name: str = "value", **options) -> DataFrame:
    """A wide CSV file whose header has two rows: years over the value columns
    (a blank one continues the year to its left), quarters below them, and the
    names of the first ``id_columns`` columns in the second row -> those columns
    and year, quarter, ``value_name`` (double), a row per filled cell.

    The header rows name the columns, so a file that grows by a quarter needs
    no new schema; they, and any repetition of them, are no data.  A cell that
    isn't a number fails the job.
    """
    raw = spark.read.options(**options).option("header", "false").csv(path)
    top, low = (list(r) for r in raw.head(2))  # a file's first two rows
    labels, year = {}, None
    for i in range(id_columns, len(raw.columns)):
        year = (top[i] or "").strip() or year
        labels[raw.columns[i]] = (year, (low[i] or "").strip().lower())
    if any(y is None or not y.isdigit() or not re.fullmatch("q[1-4]", q) for y, q in labels.values()):
        raise ValueError(f"header is not years over quarters: {labels}")
    ids = raw.columns[:id_columns]
    head = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[i])) for i, c in enumerate(ids)]) for row in (top, low)])
    long = raw.where(~head).unpivot(ids, list(labels), "label", "cell").where("trim(cell) <> ''")
    named = F.create_map(*[F.lit(x) for c, (y, q) in labels.items() for x in (c, f"{y} {q}")])
    when = F.split(F.element_at(named, F.col("label")), " ")
    return long.select(*[F.col(c).alias((low[i] or "").strip()) for i, c in enumerate(ids)], when[0].cast("int").alias("year"),
                       when[1].alias("quarter"), F.trim("cell").cast("double").alias(value_name))


SERIES_DATA = T.ArrayType(T.StructType([
    T.StructField("year", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("periodName", T.StringType()),
    T.StructField("latest", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("footnotes", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
]))

SERIES_RESPONSE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("Results", T.StructType([
        T.StructField("series", T.ArrayType(T.StructType([T.StructField("data", SERIES_DATA)]))),
    ])),
])


def flatten_series_response(df: DataFrame, json_col: str = "value", ok_status: str = "REQUEST_SUCCEEDED", keep=()) -> DataFrame:
    """API response documents -> one row per data point of the first series, with
    the columns ``keep``; failed responses, and those without a series, are
    dropped."""
    parsed = df.select(*keep, F.from_json(F.col(json_col), SERIES_RESPONSE).alias("r"))
    return (parsed.filter(F.col("r.status") == ok_status)
                  .select(*keep, F.explode(F.try_element_at("r.Results.series", F.lit(1)).getField("data")).alias("d"))
                  .select(*keep, "d.year", "d.period", "d.periodName", "d.latest", "d.value"))


# ------------------------------------------------------------------ sinks ----

def overwrite_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet",
                    partition_by=None) -> None:
    """Replace a table atomically from the reader's point of view
    (``mode('overwrite')`` instead of DROP + CTAS)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(name)


def refresh_partitions(df: DataFrame, path: str, partition_by, fmt: str = "parquet", expected=None) -> None:
    """Write ``df`` into the partitioned table at ``path``: the partitions that
    it has rows for are replaced whole, the others stay.  With ``expected``, the
    columns must be these.  Rows of a partition come together first, so each
    partition gets few files."""
    if expected is not None and sorted(df.columns) != sorted(expected):
        raise ValueError(f"columns {sorted(set(df.columns) ^ set(expected))} differ from the table's")
    (df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))


def write_stage(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    """Write an interim stage (one directory per stage name)."""
    out = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").format(fmt).save(out)
    return out


def write_column_contract(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Store ``df.columns`` as a one-column table (rewrite of the contract)."""
    spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "idx int, column string") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def read_column_contract(spark: SparkSession, path: str) -> list[str]:
    return [r["column"] for r in spark.read.parquet(path).orderBy("idx").collect()]
