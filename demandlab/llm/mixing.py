"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt in blocks of equal numbers of words.  Sources get whole
numbers of blocks by highest quotients target / (2 k + 1); the shards of a
source share its blocks in the same way by their sizes.  A shard is a seeded
order of some thousand documents, read as a ring of words; its blocks are a
run of that ring that begins at a seeded place and goes round twice at most.
So no document is taken more than twice, and reruns agree.

Everything here is DataFrame expressions; only (doc_id, source, size) is moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

SPACES = r"[\x20\x09-\x0D]+"
NEXT_WORD = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
TRIMMED = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    core = F.btrim(text, F.lit(TRIMMED))
    return F.when(F.coalesce(core, F.lit("")) == "", F.lit(0).cast("long")) \
        .otherwise(F.size(F.split(core, SPACES)).cast("long"))


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def apportion(shares: DataFrame, within: Sequence[str], tie: str) -> DataFrame:
    """Adds ``quota``: whole seats by highest quotients (Sainte-Lague).

    ``shares`` has ``share`` (double), ``stock`` (most seats of the row) and
    ``seats`` (to be dealt in the group ``within``).  Ties go to the smaller
    ``tie``.  A row surely gets the seats below ``low``: rounding moves no more
    than half a seat a row, so the divisor that deals all seats lies within
    rows / (2 seats) of the plain one.  Only quotients in that margin are listed
    and ranked, a few a row.
    """
    group = Window.partitionBy(*within)
    total, rows = F.sum("share").over(group), F.count("*").over(group)
    fair = F.when(total > 0, F.col("share") * F.col("seats") / total).otherwise(0.0)
    margin = fair * rows / (2 * F.greatest("seats", F.lit(1))) + 2
    bounds = shares.withColumn("fair", fair).withColumn("margin", margin) \
        .withColumn("low", F.least("stock", F.greatest(F.lit(0), F.floor(F.col("fair") - F.col("margin"))).cast("long"))) \
        .withColumn("high", F.least("stock", F.floor(F.col("fair") + F.col("margin")).cast("long"))) \
        .withColumn("open", F.col("seats") - F.sum("low").over(group))
    listed = bounds.where("high > low").withColumn("k", F.explode(F.sequence("low", F.col("high") - 1)))
    ranked = listed.withColumn("place", F.row_number().over(
        Window.partitionBy(*within).orderBy(F.desc(F.col("share") / (2 * F.col("k") + 1)), tie, "k")))
    won = ranked.where("place <= open AND share > 0").groupBy(*within, tie).agg(F.count("*").alias("won"))
    return bounds.join(won, [*within, tie], "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))) \
        .drop("fair", "margin", "low", "high", "open", "won")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, size rows) -> source, source_no, docs, source_size, target.

    Sources in code point order, null last, weigh ``weights``, repeating.  They
    share ``share`` times all words; a target stops at ``most`` times the
    source's size and the excess is shared again by weight.  Ordered by
    most * size / weight, the sources that stop are the first ones.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    src = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")) \
        .withColumn("source_no", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")) \
        .withColumn("goal", F.sum("source_size").over(every) * share).withColumn("weights", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("cap0", F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("weight0", F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("stops", (F.col("goal") - F.col("cap0")) * F.col("weight") > F.col("cap") * (F.col("weights") - F.col("weight0")))
    rest = F.col("goal") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.col("weights") - F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0)).over(every)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(rest / open_weight * F.col("weight"))
    return src.withColumn("target", target).select("source", "source_no", "docs", "source_size", "cap", "target")


def _plan(sizes: DataFrame, block: int, shard_docs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Source table (with numbers and targets) and shard quotas of (doc_id, source, size) rows."""
    src = source_targets(sizes).withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy()) * 1.5 / block)) \
        .withColumn("share", F.col("target")).withColumn("stock", F.floor(F.col("cap") / block)).withColumn("all", F.lit(0))
    src = stage_table(apportion(src, ["all"], "source_no").withColumn("shards", F.ceil(F.col("docs") / shard_docs))
                      .select(F.col("source").alias("name"), "source_no", "source_size", "target", "shards",
                              F.col("quota").alias("seats")), "sources")
    shard = _place(sizes, src, seed).groupBy("source_no", "shard") \
        .agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats")) \
        .withColumn("share", F.col("shard_size").cast("double")).withColumn("stock", F.floor(2 * F.col("shard_size") / block))
    return src, stage_table(apportion(shard, ["source_no"], "shard").select("source_no", "shard", "shard_size", "quota"), "quotas")


def _place(rows: DataFrame, src: DataFrame, seed: str) -> DataFrame:
    order = _hash32(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.join(src, rows.source.eqNullSafe(src.name)).drop("source", "name") \
        .withColumn("order", order).withColumn("shard", F.pmod("order", F.col("shards")))


def _deal(rows: DataFrame, src: DataFrame, quotas: DataFrame, block: int, seed: str, *last: str) -> DataFrame:
    """Adds to (doc_id, source, size, ...) what the mix takes of each row;
    ``last`` orders rows of equal doc_id and size."""
    ring = Window.partitionBy("source_no", "shard").orderBy("order", F.asc_nulls_last("doc_id"), "size", *last)
    rows = _place(rows, src, seed).withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("start", F.col("end") - F.col("size")).join(quotas, ["source_no", "shard"])
    length, words = F.greatest("shard_size", F.lit(1)), F.col("quota") * block
    rows = rows.withColumn("rounds", F.floor(words / length)).withColumn("run", F.pmod(words, length)) \
        .withColumn("from", F.pmod(_hash32(F.lit(seed), F.col("source_no"), F.col("shard")), length))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least("end", hi) - F.greatest("start", lo)).cast("long")

    rows = rows.withColumn("ahead", overlap(F.col("from"), F.least(F.col("from") + F.col("run"), F.col("shard_size")))) \
        .withColumn("behind", overlap(F.lit(0), F.col("from") + F.col("run") - F.col("shard_size"))) \
        .withColumn("skip", F.greatest(F.lit(0), F.col("from") - F.col("start")))
    return rows.withColumn("taken", (F.col("rounds") * F.col("size") + F.col("ahead") + F.col("behind")).cast("long"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"), *more)


def mix(docs: DataFrame, block: int = 4, shard_docs: int = 4096, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> doc_id, size, source_size, target,
    taken: the words that the mix takes of the row, repeats counted.

    Null or blank texts have size 0 and are taken 0 times.  A null source is a
    source of its own, the last one.  Rows with a null doc_id take part like any
    other; repeated rows are documents of their own.  Other columns are ignored.
    A source's taken words differ from its target by a few blocks, and by less
    than one block in each of its shards (``shard_docs`` documents on average).
    """
    sizes = stage_table(_sized(docs), "sizes")
    src, quotas = _plan(sizes, block, shard_docs, seed)
    return _deal(sizes, src, quotas, block, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = 4, shard_docs: int = 4096, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every whole time a
    document is taken, and one for each part (its words with the white space
    between them).
    n_chars, if there, is the new text's length.  Rows that are taken 0 times go,
    those of null or blank texts too; see ``mix`` for the other cases.

    Rows are numbered in a written table; shards are laid out by (row_no, size)
    alone and the texts meet only their own cuts."""
    numbered = stage_table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no")), "numbered")
    text = F.col("row.text").cast("string")
    sizes = stage_table(numbered.select(
        "row_no", "row.doc_id", F.col("row.source").cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(text).alias("mark")), "sizes")
    src, quotas = _plan(sizes, block, shard_docs, seed)
    cuts = _deal(sizes, src, quotas, block, seed, "mark").where("taken > 0") \
        .select("row_no", "size", "rounds", "skip", "ahead", "behind")
    dealt = numbered.join(stage_table(cuts, "cuts"), "row_no")
    words = F.split(F.btrim(F.col("row.text").cast("string"), F.lit(TRIMMED)), NEXT_WORD)  # each with the white space after it

    def part(first: Column, n: Column) -> Column:
        some = F.rtrim(F.array_join(F.slice(words, (first + 1).cast("int"), n.cast("int")), ""), F.lit(TRIMMED))
        return F.when(n == F.col("size"), F.array(F.col("row.text").cast("string"))).when(n > 0, F.array(some)) \
            .otherwise(F.array().cast("array<string>"))

    texts = F.concat(F.array_repeat(F.col("row.text").cast("string"), F.col("rounds").cast("int")),
                     part(F.col("skip"), F.col("ahead")), part(F.lit(0), F.col("behind")))
    new = dealt.select("row", F.explode(texts).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return new.select(*[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col(f"row.`{f.name}`").alias(f.name)
                        for f in docs.schema])


# The same rows for DuckDB.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src0 AS (
  SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
src1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no, 2 * source_size AS cap FROM src0),
src2 AS (
  SELECT *, [5, 2, 1][CAST((source_no - 1) % 3 + 1 AS INT)] AS weight FROM src1),
src3 AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS goal, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS cap0, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight0
  FROM src2 WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src4 AS (SELECT *, (goal - cap0) * weight > cap * (weights - weight0) AS stops FROM src3),
src5 AS (
  SELECT *, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
      (goal - CAST(sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS BIGINT))
      / (weights - CAST(sum(CASE WHEN stops THEN weight ELSE 0 END) OVER () AS BIGINT)) * weight END AS target FROM src4),
srcq AS (
  SELECT *, target AS share, CAST(floor(goal / 4) AS BIGINT) AS seats, CAST(floor(cap / 4) AS BIGINT) AS stock FROM src5),
-- highest quotients, all of them listed
srck AS (SELECT source_no, share, seats, unnest(range(0, stock)) AS k FROM srcq),
srcr AS (SELECT *, row_number() OVER (ORDER BY share / (2 * k + 1) DESC, source_no, k) AS place FROM srck WHERE share > 0),
srcw AS (SELECT source_no, count(*) AS quota FROM srcr WHERE place <= seats GROUP BY source_no),
src AS (SELECT source, srcq.source_no, docs, source_size, target, coalesce(quota, 0) AS quota, CAST(ceil(docs / 4096) AS BIGINT) AS shards
        FROM srcq LEFT JOIN srcw USING (source_no)),
placed AS (
  SELECT doc_id, size, source_no, source_size, target, quota AS seats,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS ord,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % shards AS shard
  FROM sizes JOIN src ON sizes.source IS NOT DISTINCT FROM src.source),
shd AS (
  SELECT source_no, shard, any_value(seats) AS seats, CAST(sum(size) AS BIGINT) AS shard_size FROM placed GROUP BY ALL),
shdk AS (SELECT source_no, shard, seats, CAST(shard_size AS DOUBLE) AS share, unnest(range(0, CAST(floor(2 * shard_size / 4) AS BIGINT))) AS k FROM shd),
shdr AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY share / (2 * k + 1) DESC, shard, k) AS place FROM shdk),
shdw AS (SELECT source_no, shard, count(*) AS quota FROM shdr WHERE place <= seats GROUP BY ALL),
quotas AS (
  SELECT source_no, shard, shard_size, greatest(shard_size, 1) AS len, coalesce(quota, 0) * 4 AS words,
         CAST('0x' || substr(md5('mix:' || source_no || ':' || shard), 1, 8) AS BIGINT) % greatest(shard_size, 1) AS beg
  FROM shd LEFT JOIN shdw USING (source_no, shard)),
ring AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY ord, doc_id NULLS LAST, size
                                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM placed),
cut AS (
  SELECT doc_id, size, source_size, target, fin - size AS beg_doc, fin, beg, words // len AS rounds, words % len AS run, shard_size
  FROM ring JOIN quotas USING (source_no, shard))
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(fin, least(beg + run, shard_size)) - greatest(beg_doc, beg))
            + greatest(0, least(fin, beg + run - shard_size) - greatest(beg_doc, 0)) AS BIGINT) AS taken
FROM cut
"""
