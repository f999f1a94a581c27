"""Shared helpers: table access, the shared scratch folder and connected components."""

from __future__ import annotations

import contextlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.session import delete_at_end, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct, so that helper columns beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(columns: list[str], row: str = "row") -> list[F.Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def beside(docs: DataFrame, value: F.Column, names: dict[str, str], **others: F.Column) -> DataFrame:
    """``docs`` plus fields of the struct ``value`` under new names and ``others``; a column of such a name is replaced."""
    rows = docs.select(whole_row(docs).alias("row"), value.alias("value"), *[c.alias(f"other_{n}") for n, c in others.items()])
    new = {n.lower() for n in (*names.values(), *others)}
    kept = unpacked([c for c in docs.columns if c.lower() not in new])
    return rows.select(*kept, *[F.col(f"other_{n}").alias(n) for n in others], *[F.col("value").getField(f).alias(n) for f, n in names.items()])


def give_back() -> None:
    """Returns to the system what the allocators of a Python worker keep: it stays idle beside later phases for a minute."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library other than glibc
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables written under the shared checkpoint folder, so that a lost executor loses no intermediate result.

    A table that a returned frame still reads stays until the session ends; ``keep_only`` removes all others.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.names: set[str] = set()
        self.root = f"{shared_folder(spark)}/noveltide/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        delete_at_end(self.spark, self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_only(self, *names: str) -> None:
        for name in self.names - set(names):
            self.drop(name)
        self.release()

    def drop(self, name: str) -> None:
        self.names.discard(name)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self, wait: float = 0) -> None:
        """Let Spark's context cleaner remove the shuffle files of finished phases now, not at its next half-hourly run.
        It works beside the driver; ``wait`` gives it so many seconds before the next phase writes its own."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(wait)


def gathered(few: int, *tables: DataFrame) -> list[DataFrame]:
    """``tables`` of ``few`` rows at most together as one partition each, so that what reads them runs in one task without
    a shuffle; larger ones as they are. They are counted, so they should be files."""
    if few and sum(t.count() for t in tables) <= few:
        return [t.coalesce(1) for t in tables]
    return list(tables)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Connected components of an undirected graph, as (id, root) with root the smallest id reachable.

    ``edges`` has two columns of one orderable type; nulls and loops are ignored and nodes without an edge
    do not appear. Alternating large-star and small-star rounds: every step is an aggregate and an equi-join
    (adaptive execution splits the hot ones), each round's edges are written to the shared scratch folder, and
    the driver sees three numbers a round. Where a file of edges holds ``few`` at most, each round is one task, since its
    shuffles would take as many tasks as those of a large one.
    """
    a, b = edges.columns[:2]
    given, [edges] = edges, gathered(few, edges)
    one = (lambda df: df) if edges is given else (lambda df: df.coalesce(1))  # files and unions have more partitions
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    e = scratch.keep(e, "cc0")
    seen = None
    for k in range(1, max_rounds + 1):
        both = one(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        e = scratch.keep(one(small).distinct(), f"cc{k}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        scratch.drop(f"cc{k - 1}")
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = one(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
