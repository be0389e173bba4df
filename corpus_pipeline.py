"""From raw documents to packed training sequences: STAGES in order, each over all that the one before kept.

Every stage but the last returns the columns of documents: doc_id, text, lang, source, n_chars. Null and empty texts
fail the quality rules; an empty table passes through as one; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard, mixing, packing, quality, repeats
from tidemill.llm.common import checked_broadcast, stored, table, text_or_empty
from tidemill.llm.word_ids import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ends each document's token ids.
END_ID = 2
#: The robust estimates, the links and the packing are not expressible in SQL; tests/llm compares each stage's rows with
#: a plain version on the same input.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers of their language and source go."""
    return quality.kept(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays. Rows that repeat doc_id and text are one
    document; those that repeat doc_id with another text are judged by their own text; a row without doc_id stays."""
    found = stored(jaccard.linked(docs, by_text=True), "linked")
    gone = stored(found.where("doc_id != component_id").select("doc_id", "text_hash").distinct(), "gone")
    again = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = docs.select(*COLUMNS, F.xxhash64(text_or_empty()).alias("text_hash")).join(checked_broadcast(gone), ["doc_id", "text_hash"], "left_anti")
    again_side = checked_broadcast(again)
    once = left.join(again_side, "doc_id", "left_anti")
    return once.unionByName(left.join(again_side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a string of 400 bytes, and of a passage of 50 words, that stands twice goes; n_chars is of what is left."""
    return repeats.removed(docs.select(*COLUMNS), cut_passages=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, a row for each piece of a document."""
    return packing.packed(docs, default_path(), END_ID)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", suffix_dedup), ("mixing sources to target weights", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
