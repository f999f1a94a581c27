"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``. Null
and repeated doc_ids stay rows of their own in every stage; language ID drops null texts, the other stages take them (a null
text has no lines and no words, is clean, and has null ids). Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm import decontam, langid, line_dedup, sentencepiece, simhash
from noveltide.llm.common import Scratch, table, unpacked, whole_row

#: SQL cannot express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts, and texts without a letter."""
    return langid.identify(spark, docs, prefix="__li_").where("__li_lang_pred <> 'und'").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes near-duplicate lines out of texts; n_chars follows the text. No document is dropped."""
    out = line_dedup.dedup_lines(spark, docs, prefix="__ld_")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts whose sets of five-word shingles have similarity 0.8 or more, links taken
    together: the first by (doc_id, text, other columns), a null doc_id last. Rows that only share a doc_id, null
    included, stay apart."""
    found = simhash.similar_rows(spark, docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), "key", "root").distinct()
    rows = docs.select(F.xxhash64("text").alias("k"), F.col("doc_id").cast("long").alias("d"), whole_row(docs).alias("row"))
    rows = rows.join(keep, F.expr("k = key and d <=> id"))
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"]
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("row.text").alias("text"), *rest)).alias("row"))
    return first.select(*unpacked(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontam.contamination(spark, docs, table(spark, sf_dir, "benchmark"), prefix="__dc_").where(~F.col("__dc_contaminated")).select(docs.columns)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: n_tokens, ids_sha256 and round_trip take the text's place."""
    return sentencepiece.round_trip(docs).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
