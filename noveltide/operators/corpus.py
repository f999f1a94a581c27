"""Corpus operators: decontamination by hash, keep-first dedup, accounting, subsets and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.functions.text import text_hash


def with_hash(df: DataFrame, column: str = "text", out: str = "h") -> DataFrame:
    return df.withColumn(out, text_hash(F.col(column)))


def banned_hashes(*sets: DataFrame, column: str = "text") -> DataFrame:
    """(h): the distinct hashes of any number of text tables."""
    out = None
    for s in sets:
        h = s.select(text_hash(F.col(column)).alias("h"))
        out = h if out is None else out.union(h)
    return out.distinct()


def decontaminate(df: DataFrame, banned: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text is not banned; repeats stay. Broadcast or shuffled as the size of ``banned`` suggests to Spark."""
    return with_hash(df, column, "__h").join(banned.withColumnRenamed("h", "__h"), "__h", "left_anti").drop("__h")


def overlapping(df: DataFrame, banned: DataFrame, column: str = "text") -> DataFrame:
    return with_hash(df, column, "__h").join(banned.withColumnRenamed("h", "__h"), "__h", "left_semi").drop("__h")


def assert_no_overlap(df: DataFrame, banned: DataFrame, column: str = "text") -> None:
    """Raise with an example where a banned text occurs."""
    if (hit := overlapping(df, banned, column).select(F.substring(column, 1, 80)).first()) is not None:
        raise ValueError(f"a frozen text occurs in the data: {hit[0]!r}")


def dedup_keep_first(df: DataFrame, order: list[Column | str], column: str = "text", out: str | None = None) -> DataFrame:
    """The first row of each normalised text, by ``order`` and then the text itself; with ``out``, also its hash.

    One aggregate by the hash: a hot text costs one row a task, and rows are shuffled once.
    """
    rows = df.select(text_hash(F.col(column)).alias("h"), F.struct(*order, F.col(column)).alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    first = rows.groupBy("h").agg(F.min_by("row", "place").alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in df.columns], *([F.col("h").alias(out)] if out else []))


def exclusion_accounting(df: DataFrame, banned: DataFrame, column: str = "text") -> DataFrame:
    """One row: n_raw, n_kept, n_contaminated, n_duplicate; raises where they do not add up."""
    keyed = df.select(text_hash(F.col(column)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    marked = keyed.join(banned.withColumn("bad", F.lit(True)), "h", "left")
    bad = F.coalesce("bad", F.lit(False))
    out = marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_raw"),
        F.count(F.when(~bad, 1)).alias("n_kept"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_contaminated"),
        F.coalesce(F.sum(F.when(~bad, F.col("n") - 1)), F.lit(0)).alias("n_duplicate"),
    )
    return check_accounting(out)


def check_accounting(counts: DataFrame) -> DataFrame:
    wrong = F.col("n_raw") != F.col("n_kept") + F.col("n_contaminated") + F.col("n_duplicate")
    return counts.withColumn("n_raw", F.when(wrong, F.raise_error(F.lit("raw is not kept + contaminated + duplicate")).cast("long")).otherwise(F.col("n_raw")))


def manifest(counts: DataFrame, kept: DataFrame, banned: DataFrame) -> DataFrame:
    """The accounting row with samples of five hashes each, in order."""
    top = lambda df, name: df.orderBy("h").limit(5).agg(F.array_sort(F.collect_list("h")).alias(name))
    return counts.crossJoin(top(kept.select(text_hash(F.col("text")).alias("h")).distinct(), "kept_sample")).crossJoin(top(banned, "banned_sample"))


def seeded_subset(df: DataFrame, key: str, seed: int, n: int, group: str | None = None) -> DataFrame:
    """``n`` rows (of each group) in the order of a seeded hash: the same sample in every engine."""
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    if group is None:
        return df.withColumn("__r", rank).orderBy("__r", key).limit(n).drop("__r")
    w = Window.partitionBy(group).orderBy("__r", key)
    return df.withColumn("__r", rank).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__r", "__k")


def require_rows(df: DataFrame, least: int = 20) -> DataFrame:
    if (n := df.limit(least).count()) < least:
        raise ValueError(f"at least {least} rows are needed, {n} are left")
    return df


def with_fallback(df: DataFrame, bank: DataFrame, least: int = 20) -> DataFrame:
    return df if df.limit(least).count() >= least else bank


