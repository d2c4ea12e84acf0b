"""Corpus preparation: quality classifier, near-duplicates, secret scans, mixing
sources, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.  Nulls,
empty tables, repeated rows and extra columns are handled as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandlab.llm import bpe, mixing, partenum, quality, secret_scan
from demandlab.llm.common import Stages, read, ship_code


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go.  It learns
    from ``labels`` outside the held-out fold; without labels all stay."""
    ship_code(spark)
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles,
    Jaccard similarity of 0.8 or more): the one with the smallest doc_id."""
    ship_code(spark)
    return partenum.one_of_each(docs, size=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by [secret]; n_chars follows the text."""
    ship_code(spark)
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times, or in part."""
    ship_code(spark)
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    import public_tokenizers
    ship_code(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifier, the inferred formats and the tokenizer have no SQL form;
#: tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written as Parquet and
    read again as the next stage's docs, after which it is deleted."""
    stages = Stages(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stages.table(stage(spark, docs, sf_dir), f"stage-{name}")
        stages.close(keep=(f"stage-{name}",))
    return STAGES[-1][1](spark, docs, sf_dir)
