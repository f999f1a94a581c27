"""Sinks: JSON lines, one-row JSON, incremental appends, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def summary_json(df: DataFrame) -> str:
    """A one-row frame as JSON text."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    return rows[0][0]


def append_batches(good: str, bad: str, is_bad: str):
    """A ``foreachBatch`` function: each batch is appended, rows that ``is_bad`` (SQL) holds for to a table of their own.

    The batch number is a partition, and a batch that is tried again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__bad", F.coalesce(F.expr(is_bad), F.lit(True)))
        for path, rows in ((good, marked.where("not __bad")), (bad, marked.where("__bad"))):
            rows.drop("__bad").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
