"""The registered queries of this subpackage and their SQL twins.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed_dedup, langid, line_dedup, lm_score, quality, sentencepiece, simhash, warc
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and whether decoding them gives the text back."""
    return sentencepiece.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds benchmark passages, which items, and the longest overlap."""
    return decontam.contamination(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed and the digest of the text that is left."""
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.control_conversation(spark))
    return chat.read_back(spark, chat.format_turns(spark, rows, formatted=False))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, and the backoff score under the counts of all other documents."""
    out = lm_score.score(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_decontamination, op3_line_dedup, op4_embedding_dedup, op5_chat_format, op6_lm_score, op7_language_id, op8_simhash_dedup, op9_warc, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op6_lm_score": lm_score.ORACLE_SQL}
