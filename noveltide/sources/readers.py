"""Readers: JSON lines (strict and tolerant), JSON artifacts, TOML settings, file digests."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file under a fixed schema (a name in SCHEMAS or DDL); blank lines are skipped."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "PERMISSIVE").json(path)


def read_jsonl_head(spark: SparkSession, path: str, schema: str, lines: int = 2000) -> DataFrame:
    """Rows of each file's first physical lines that parse; blank and malformed lines count towards the limit."""
    text = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    ddl = SCHEMAS.get(schema, schema)
    head = text.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("k") <= lines)
    parsed = head.where(F.trim("value") != "").select("k", F.from_json("value", ddl + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r.__bad").isNull()).select("r.*").drop("__bad")


def read_many(spark: SparkSession, paths: list[str], schema: str, lines: int = 2000) -> DataFrame:
    """Union of the paths that exist, tolerantly read."""
    out = spark.createDataFrame([], SCHEMAS.get(schema, schema))
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out = out.unionByName(read_jsonl_head(spark, p, schema, lines))
    return out


def read_probes(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """(probe_id, text) of a probe file; raises where its seed is another."""
    raw = spark.read.schema("seed long, strings array<string>").option("multiLine", True).json(path)
    if seed is not None and (found := raw.select("seed").first()[0]) != seed:
        raise ValueError(f"the probes' seed is {found}, not {seed}")
    return raw.select(F.posexplode("strings").alias("probe_id", "text"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(domain, text) of a JSON list of strings, or of an object whose ``domains`` maps names to lists."""
    raw = spark.read.option("wholetext", True).text(path)
    flat = raw.select(F.lit(None).cast("string").alias("domain"), F.explode(F.from_json("value", "array<string>")).alias("text"))
    by = raw.select(F.explode(F.from_json("value", "domains map<string,array<string>>")["domains"]).alias("domain", "texts")).select("domain", F.explode("texts").alias("text"))
    return flat.where("text is not null").unionByName(by)


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tasks array<struct<id:string,domain:string,input:string>>").option("multiLine", True).json(path).select(F.inline("tasks"))


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    lambda_g: float = 0.0
    lambda_g_mas: float = 1.0
    delta_d: float = 0.0
    n: int = 3
    k: int = 512
    d: int = 384
    boundary_threshold: float = 0.5
    lm_order: int = 3
    n_samples: int = 4
    temperature: float = 1.0
    version: str = "v1"
    seed: int = 42


def read_settings(text: str, base: Settings = Settings()) -> Settings:
    """Settings from TOML text; tables are flattened, unknown keys ignored."""
    flat: dict = {}

    def walk(node: dict) -> None:
        for k, v in node.items():
            walk(v) if isinstance(v, dict) else flat.__setitem__(k.lower(), v)

    walk(tomllib.loads(text))
    names = {f.name for f in fields(Settings)}
    return replace(base, **{k: v for k, v in flat.items() if k in names})


def file_digests(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", "^.*" + (root.rstrip("/") + "/" if root else "/"), "")
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))


def verify_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem): files of the manifest that are missing or differ."""
    j = manifest.select("file", F.col("sha256").alias("want")).join(found.select("file", "sha256"), "file", "left")
    return j.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("want"))).select("file", F.when(F.col("sha256").isNull(), "missing").otherwise("differs").alias("problem"))


def creative_chats(chats: DataFrame, category: str = "Creative Content Generation") -> DataFrame:
    return chats.where(F.exists("categories", lambda c: c["category"] == category))


def low_novelty(ideas: DataFrame, most: int = 2) -> DataFrame:
    return ideas.where(F.col("novelty_score") <= most)
