"""Structured Streaming: windows and sessions over events, exact repeats, and the bounded revise loop."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.session import delete_at_end, shared_folder

DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Events as a stream of files with a proper timestamp."""
    files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(path)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n, value_sum); late rows are dropped behind the watermark where there is one."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value_sum): a user's events with no gap of ``gap`` between neighbours."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value_sum")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: State on the executors' disks, with a bound on its memory for all stores of an executor together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """STATE holds for streams started inside; a state store that the session names itself is kept."""
    own = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    before = {k: spark.conf.get(k, None) for k in STATE} if own in ("", DEFAULT_STORE) else {}
    try:
        for k in before:
            spark.conf.set(k, STATE[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote: Parquet files in the shared folder, which go when the session
    ends, so that neither the rows nor the state have to fit into memory. Files only take appended rows; in other modes
    the result is a memory table, which the driver has to hold."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/noveltide/{name}-{uuid.uuid4().hex[:12]}"
    with state_on_disk(spark):
        out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        if mode != "append":
            out.format("memory").queryName(name).start().awaitTermination()
            delete_at_end(spark, path)
            return spark.table(name)
        rows = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        rows.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(rows)  # a stream without files writes nothing
        delete_at_end(spark, path)
        out.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


REVISED = "key string, round int, approved boolean, text string, done boolean"


def revise_loop(verdicts: DataFrame, max_rounds: int = 2) -> DataFrame:
    """(key, round, approved, text, done) from a stream (key, seq, text, approved): each answer ends a round; a key is
    done at its first approval or after ``max_rounds`` rounds (one at least), and later answers are ignored."""
    most = max(1, max_rounds)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, done = state.get if state.exists else (0, False)
        rows = []
        x = pd.concat(list(batches)).sort_values("seq")
        for approved, text in zip(x["approved"], x["text"]):
            if done:
                break
            n, ok = n + 1, bool(approved)
            done = ok or n >= most
            rows.append((key[0], n, ok, text, done))
        state.update((n, done))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REVISED.split(", ")])

    return verdicts.groupBy("key").applyInPandasWithState(step, REVISED, "round int, done boolean", "append", "NoTimeout")
