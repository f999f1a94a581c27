"""Session helper for tests, benches and local use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of our own, in a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = own.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="noveltide-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system remove ``path`` when the session's process ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the plan, survives lost executors, and
    goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/noveltide/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with adaptive execution and as many shuffle partitions as cores."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("noveltide")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
