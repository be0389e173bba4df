"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, mixing, order_minhash, packing, quality, repeats, token_counts, token_files, toxicity
from .common import table
from .word_ids import default_path

END_ID = 2


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of each whole text under the word-level BPE file's tokens."""
    return token_counts.counts(table(spark, sf_dir, "documents"), default_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without its repeated 400-byte strings, and its words in repeated passages of 50 words."""
    return repeats.removed(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, the base rule and the robust verdict of each document."""
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in each whole text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed(table(spark, sf_dir, "documents"), default_path(), END_ID)


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model that is fitted on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from bit-packed token files."""
    return token_files.token_files(table(spark, sf_dir, "documents"), default_path(), END_ID)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of the links at 80 hundredths."""
    return jaccard.linked(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_quality_rules, op4_mix_sources, op5_license_scan, op6_order_minhash, op7_nnls_packing, op8_toxicity_trees, op9_packed_token_files, op10_ngram_jaccard)}

ORACLE_SQL = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM by_source
), shared AS (
  SELECT *, row_number() OVER w AS nth,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unit
  FROM weighted WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST)
), level AS (
  SELECT arg_min(unit, nth) AS unit FROM shared WHERE NOT weight * unit > source_size * 3
), targets AS (
  SELECT source, source_size, CASE WHEN weight * s.unit > source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE least(weight * level.unit, CAST(source_size * 3 AS DOUBLE)) END AS target
  FROM shared s, level
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
""",
}
