"""Embedding near-dedup: all pairs of vectors with cosine >= threshold, by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t). Vectors are rotated onto principal axes (fitted on a
bounded sample; any rotation keeps distances, so the fit only affects speed), cut into grid cells of side eps on the
leading axes and sorted by cell. The sorted sequence is dealt into blocks; two blocks are joined unless the distance
of their bounding boxes on the leading axes exceeds eps, and inside a task both sequences are halved recursively by
the same bound down to small leaves, which are compared exactly in double precision.

Equal vectors are one class with a count, so copies are never paired with each other. A task never lists pairs: it
adds up link counts and reduces the links it has seen to a spanning forest. Components then come from
``common.components``.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different
length never link. Rows that repeat a vec_id stay separate rows; those of a component's smallest vec_id are all kept. A
null vec_id is never kept. A cosine of exactly the threshold links. An empty table gives an empty table. Labels and other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

AXES, BLOCK, LEAF, SAMPLE, SLACK = 8, 4096, 256, 8192, 1e-9
#: Blocks grow beyond BLOCK rows rather than exceed this number, which bounds the plan made on the driver.
MOST_BLOCKS = 4096


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def valid(col) -> F.Column:
    """Non-empty, no null, NaN or infinity, not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(col) > 0) & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))


class Forest:
    """Union-find over row numbers, with links given in bulk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = self.up[s]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.roots(x), self.roots(y)
            differ = a != b
            if not differ.any():
                return
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((lo, hi))
            first = np.concatenate(([True], hi[order][1:] != hi[order][:-1]))
            self.up[hi[order][first]] = lo[order][first]


def apart(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float(np.sqrt((gap * gap).sum(-1)))


def interval_join(a: np.ndarray, b: np.ndarray | None, eps: float) -> Iterator[tuple[slice, slice]]:
    """Leaf intervals of two sequences (b None: of one with itself) whose boxes are within eps."""
    same = b is None
    b = a if same else b
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or (same and k + (m - k) <= i):
            continue
        if not (same and i == k and j == m) and apart(a[i:j].min(0), a[i:j].max(0), b[k:m].min(0), b[k:m].max(0)) > eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield slice(i, j), slice(k, m)
            continue
        u, v = (i + j) // 2, (k + m) // 2
        left, right = ([(i, j)] if j - i <= LEAF else [(i, u), (u, j)]), ([(k, m)] if m - k <= LEAF else [(k, v), (v, m)])
        todo += [(*p, *q) for p in left for q in right if not (same and q[0] < p[0])]


def _one_length(spark: SparkSession, classes: DataFrame, length: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, links) and (x, y) of the classes whose vectors have this length."""
    n = classes.count()
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").limit(SAMPLE).toPandas()
    axes = min(AXES, length)
    rotation = np.eye(length)[:, :axes]
    if len(sample) > 1:
        m = unit(sample["embedding"])
        _, vectors = np.linalg.eigh(np.cov(m.T).reshape(length, length))
        rotation = vectors[:, ::-1][:, :axes].copy()
    cells = [f"c{k}" for k in range(axes)]
    kind = "key long, m long, embedding array<double>"

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                c = np.floor(unit(x["embedding"]) @ rotation / eps).astype(np.int32)
                yield x.assign(**{name: c[:, k] for k, name in enumerate(cells)})

    size = max(BLOCK, -(-n // MOST_BLOCKS))
    parts = max(1, -(-n // size))
    ordered = classes.select("key", "m", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(grid, kind + "".join(f", {c} int" for c in cells)).repartitionByRange(parts, *cells, "key").sortWithinPartitions(*cells, "key")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, seen = TaskContext.get().partitionId(), 0
        for x in batches:
            yield x[["key", "m", "embedding"]].assign(block=(np.int64(at) << 24) + (seen + np.arange(len(x))) // (2 * size), place=seen + np.arange(len(x)))
            seen += len(x)

    rows = scratch.keep(ordered.mapInPandas(deal, kind + ", block long, place long"), f"rows{length}")
    box = [f"{f}{k}" for f in ("lo", "hi") for k in range(axes)]

    def boxes(x: pd.DataFrame) -> pd.DataFrame:
        p = unit(x["embedding"]) @ rotation
        return pd.DataFrame([[x["block"].iloc[0], *p.min(0), *p.max(0)]], columns=["block", *box])

    found = rows.groupBy("block").applyInPandas(boxes, "block long" + "".join(f", {c} double" for c in box)).toPandas().sort_values("block")
    ids, lo, hi = found["block"].to_numpy(), found[box[:axes]].to_numpy(), found[box[axes:]].to_numpy()
    pairs = []
    for k in range(len(ids)):
        gap = np.maximum(0, np.maximum(lo[k] - hi[k:], lo[k:] - hi[k]))
        near = k + np.nonzero(np.sqrt((gap * gap).sum(1)) <= eps)[0]
        pairs.append(np.stack([np.full(len(near), ids[k]), ids[near]], 1))
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    pairs = spark.createDataFrame(pd.DataFrame({"b1": pairs[:, 0], "b2": pairs[:, 1]}).astype("int64"), "b1 long, b2 long")
    sides = pairs.select("b1", "b2", F.col("b1").alias("block")).union(pairs.where("b1 <> b2").select("b1", "b2", F.col("b2").alias("block")))

    def join(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["block", "place"], ignore_index=True)
        key, count, v = x["key"].to_numpy(), x["m"].to_numpy(), unit(x["embedding"])
        p, same, half = v @ rotation, x["b1"].iloc[0] == x["b2"].iloc[0], int((x["block"] == x["b1"]).sum())
        off = 0 if same else half
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        for s, t in interval_join(p[:half], None if same else p[half:], eps):
            hit = v[s] @ v[off + t.start : off + t.stop].T >= threshold
            i, j = np.nonzero(np.triu(hit, 1) if same and s == t else hit)
            i, j = i + s.start, j + off + t.start
            np.add.at(links, i, count[j])
            np.add.at(links, j, count[i])
            forest.link(i, j)
        root = forest.roots(np.arange(len(x)))
        out = (links > 0) | (root != np.arange(len(x)))
        return pd.DataFrame({"x": key[out], "links": links[out], "y": key[root[out]]})

    got = scratch.keep(rows.join(F.broadcast(sides) if pairs.count() < 200_000 else sides, "block").groupBy("b1", "b2").applyInPandas(join, "x long, links long, y long"), f"links{length}")
    return got.groupBy(F.col("x").alias("key")).agg(F.sum("links").alias("links")), got.where("x <> y").select("x", "y")


def near_duplicates(spark: SparkSession, rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept, n_copies (rows with an equal vector, itself included)."""
    scratch = Scratch(spark, "embed")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", valid(F.col("embedding")))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.xxhash64("embedding")))
    classes = scratch.keep(rows.where("ok").groupBy("key", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("low")), "classes")
    lengths = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    links, edges = spark.createDataFrame([], "key long, links long"), spark.createDataFrame([], "x long, y long")
    for k in lengths:
        some, more = _one_length(spark, classes.where(F.size("embedding") == k), k, threshold, scratch)
        links, edges = links.union(some), edges.union(more)
    comp = classes.select("key", "m", "low").join(components(edges, scratch).withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    comp = scratch.keep(comp.join(links, "key", "left"), "comp")
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = comp.join(lows, "root").select("key", "m", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(comp, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("m", F.lit(1)).cast("long").alias("n_copies"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
