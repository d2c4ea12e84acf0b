"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL where SQL expresses the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, host_paths, lexical, mixing, ngram_lm, quality, rabitq, rtree, secret_scan, toxicity, warc
from .common import read, ship_code
from .partenum import jaccard_components


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard similarity of 0.9 or more, all documents."""
    ship_code(spark)
    return jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness."""
    ship_code(spark)
    return fingerprint.edit_fingerprints(read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 5, 2, 1, repeating; 150 % of all words."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by their hosts' consensus paths."""
    ship_code(spark)
    return host_paths.extract_pages(read(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels outside the held-out fold."""
    ship_code(spark)
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff automaton scores of all documents."""
    ship_code(spark)
    return ngram_lm.lm_scores(read(spark, sf_dir, "documents"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    ship_code(spark)
    return rabitq.near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed patterns and inferred formats."""
    ship_code(spark)
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the public multilingual byte-level ranks."""
    import public_tokenizers
    ship_code(spark)
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to seekable archives and read them back by their index."""
    ship_code(spark)
    index, folder = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    ship_code(spark)
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding and its five positives."""
    ship_code(spark)
    return rtree.hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels outside the held-out fold."""
    ship_code(spark)
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_document_fingerprints, op3_mix_sources,
                              op4_html_extraction, op5_quality_classifier, op6_lm_scoring, op7_embedding_near_duplicates,
                              op8_secret_scans, op9_byte_level_bpe, op10_warc, op11_ranked_search, op12_hard_negatives, op13_toxicity)}
SQL: dict[str, str] = {"op3_mix_sources": mixing.MIX_SQL, "op11_ranked_search": lexical.SEARCH_SQL,
                       "op12_hard_negatives": rtree.NEGATIVES_SQL}
