"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a Hamming distance of ``radius`` or less.

Fingerprints that differ are searched with vantage-point trees. An outer tree, fitted on a bounded sample of the
distinct fingerprints (``SAMPLE_MOST``), splits all of them into shards by their Hamming distance to its vantage
points; each fingerprint lives in one shard, and also queries every shard that the triangle bound
``|d(x, v) - mu| <= radius`` does not exclude. In a shard an inner tree prunes by the same bound down to small
leaves, which are compared exactly. The sample only shapes the tree: the pairs found are all pairs.

Equal fingerprints are one node, so a group of copies costs one row in the search however large it is, and a
node has at most 1 + 64 + 2016 partners. Components come from ``common.components``.

``similar_rows`` links texts by the similarity of their shingle sets instead (0.8 or more, five words, as the pipeline
does). Similarity 0.8 is about 10 of 64 bits, and random fingerprints lie 32 +- 4 bits apart: at a radius that wide the
triangle bound excludes no branch, and trees would compare all pairs. So the trees give the pairs of up to ``radius``
bits, bands of minimum hashes those that differ by more, and every pair is verified by the exact similarity.

A null or empty text has fingerprint zero and is linked like any other. Rows that repeat a doc_id stay separate
rows. A component's id is its smallest non-null doc_id (null if it has none). A bit set in exactly half of the shingles
is 0. An empty table gives an empty table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components
from .line_dedup import PLACES, bands_of, linked, of_members, shared

SEED, BLOCK = 42, 1 << 16
SHARD, LEAF, SAMPLE_LEAF, SAMPLE_MOST = 4096, 64, 64, 1 << 20


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, in blocks of bounded size."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), BLOCK):
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], np.uint64)


def majority(blocks: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)) if n else 0


def fingerprint(text: str | None, width: int = 3) -> int:
    """The contract's fingerprint of one text, unsigned."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, key, fp): key is the text's hash, fp as the signed long of the same bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t, width) for t in x["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "key": x["key"], "fp": fp})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return keyed.mapInPandas(run, "doc_id long, key long, fp long")


def distances(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


def outer_tree(sample: np.ndarray, depth: int, path: int = 1, rng: np.random.Generator | None = None) -> dict[int, tuple[int, int]]:
    """{node: (vantage, mu)}: left holds d <= mu. Nodes are numbered as in a heap; a node that is absent is a shard."""
    rng = rng or np.random.default_rng(7)
    if depth == 0 or len(sample) < 2:
        return {}
    best = None
    for v in rng.choice(sample, min(8, len(sample)), replace=False):  # of a few, the one that spreads the rest most
        d = distances(sample, v)
        if best is None or d.std() > best[0]:
            best = (d.std(), v, d)
    _, v, d = best
    mu = int(np.median(d))
    if mu >= d.max():
        mu = int(d.max()) - 1
    if mu < d.min():
        return {}
    out = {path: (int(v), mu)}
    out |= outer_tree(sample[d <= mu], depth - 1, 2 * path, rng)
    out |= outer_tree(sample[d > mu], depth - 1, 2 * path + 1, rng)
    return out


def place(fp: np.ndarray, tree: dict[int, tuple[int, int]], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, home): the rows of ``fp`` that live in or must query each shard."""
    todo = [(1, np.arange(len(fp)), np.ones(len(fp), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node not in tree:
            yield node, rows, home
            continue
        v, mu = tree[node]
        d = distances(fp[rows], np.uint64(v))
        left, right = d - radius <= mu, d + radius > mu
        todo.append((2 * node, rows[left], home[left] & (d[left] <= mu)))
        todo.append((2 * node + 1, rows[right], home[right] & (d[right] > mu)))


def search(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, query) pairs within ``radius``, by a vantage-point tree over the points, built and queried as it descends."""
    todo = [(points, queries)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        d = distances(p, p[0]) if len(p) > LEAF else None
        if d is None or d.min() == d.max():
            step = max(1, (1 << 22) // len(p))
            for k in range(0, len(q), step):
                i, j = np.nonzero(np.bitwise_count(q[k : k + step, None] ^ p[None, :]) <= radius)
                if len(i):
                    yield p[j], q[k : k + step][i]
            continue
        mu = min(int(np.median(d)), int(d.max()) - 1)
        dq = distances(q, p[0])
        todo.append((p[d <= mu], q[dq - radius <= mu]))
        todo.append((p[d > mu], q[dq + radius > mu]))


def links(spark: SparkSession, nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(x, y), x < y: all pairs of the distinct longs in ``nodes.fp`` within ``radius`` bits."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    want = min(SAMPLE_MOST, SAMPLE_LEAF << depth)
    share = min(1.0, 1.2 * want / max(1, n))
    tree: dict[int, tuple[int, int]] = {}
    if depth:
        picked = nodes.where(F.pmod(F.xxhash64(F.lit(17), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(want)
        tree = outer_tree(np.sort(picked.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = x["fp"].to_numpy(np.int64)
            for shard, rows, home in place(fp.view(np.uint64), tree, radius):
                yield pd.DataFrame({"shard": np.int64(shard), "fp": fp[rows], "home": home})

    def join(x: pd.DataFrame) -> pd.DataFrame:
        fp = x["fp"].to_numpy(np.int64).view(np.uint64)
        out = [np.empty((0, 2), np.int64)]
        for p, q in search(fp[x["home"].to_numpy(bool)], fp, radius):
            p, q = p.view(np.int64), q.view(np.int64)
            keep = p < q  # a pair is met in the shards of both; it counts where its smaller one lives
            out.append(np.stack([p[keep], q[keep]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["x", "y"])

    return nodes.mapInPandas(deal, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(join, "x long, y long")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_copies (rows of this fingerprint)."""
    out = row_components(spark, docs, radius, width)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def row_components(spark: SparkSession, docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), fp, root (one a component), component_id, n_copies."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(fingerprints(docs, width), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies")), "nodes")
    edges = scratch.keep(links(spark, nodes.select("fp"), radius), "edges")
    comp = nodes.join(components(edges, scratch).withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    comp = scratch.keep(comp, "comp")
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = comp.join(lows, "root").select("fp", "n_copies", "root", "component_id")
    return rows.join(comp, "fp")


def places(blocks: list[np.ndarray]) -> list[int]:
    """A text's minimum hashes by place, as in ``line_dedup``: empty places borrow by fixed steps."""
    low = np.full(PLACES, 1 << 31, np.int64)
    for h in blocks:
        np.minimum.at(low, (h % np.uint64(PLACES)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64))
    full, v = low < 1 << 31, (low ^ (low >> 15)) & 65535
    out = v.copy()
    for j in np.nonzero(~full)[0].tolist():
        t = next(t for t in range(1, PLACES) if full[(j + t * (2 * j + 1)) % PLACES])
        out[j] = (v[(j + t * (2 * j + 1)) % PLACES] + 2039 * t) & 65535
    return out.tolist()


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, a, fp, n, v): key is the text's hash, a the same or 0 for texts without words, n the number of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for text in x["text"]:
                h = list(shingle_hashes(text, width))
                out.append((np.uint64(majority(h)).astype(np.int64), sum(map(len, h)), places(h) if h else [0] * PLACES))
            y = pd.DataFrame(out, columns=["fp", "n", "v"])
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64").to_numpy(), "key": x["key"].to_numpy(), "a": np.where(y["n"] > 0, x["key"].to_numpy(), 0), "fp": y["fp"], "n": y["n"], "v": y["v"]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return keyed.mapInPandas(run, "doc_id long, key long, a long, fp long, n int, v array<int>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The (x, y) of ``pairs`` whose texts' shingle sets have similarity >= threshold; texts: (a, text), one row per a."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for s, t in zip(b["s"], b["t"]):
                p, q = (np.unique(np.concatenate(list(shingle_hashes(z, width)) or [np.empty(0, np.uint64)])) for z in (s, t))
                k = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(k >= threshold * (len(p) + len(q) - k))
            yield b.loc[keep, ["x", "y"]]

    both = pairs.join(texts.select(F.col("a").alias("x"), F.col("text").alias("s")), "x").join(texts.select(F.col("a").alias("y"), F.col("text").alias("t")), "y")
    return both.select("x", "y", "s", "t").mapInPandas(run, "x long, y long")


def similar_rows(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), root (one a component), component_id (its smallest
    non-null doc_id). Texts without words are copies of each other; texts of fewer words than ``width`` have one shingle."""
    scratch = Scratch(spark, "similar")
    rows = scratch.keep(sketched(docs, width), "rows")
    nodes = scratch.keep(rows.groupBy("a").agg(F.min("doc_id").alias("low"), F.min(F.struct("fp", "n", "v")).alias("s")).select("a", "low", "s.*"), "nodes")
    sig = nodes.where("n > 0").select("a", "n", "v")
    prints = scratch.keep(nodes.where("n > 0").groupBy("fp").agg(F.min("a").alias("rep"), F.count("*").alias("k")), "prints")
    near = scratch.keep(links(spark, prints.select("fp"), radius), "near")
    rep = prints.select("fp", "rep")
    close = near.join(rep.withColumnRenamed("fp", "x").withColumnRenamed("rep", "a"), "x").join(rep.withColumnRenamed("fp", "y").withColumnRenamed("rep", "b"), "y").select("a", "b")
    same = nodes.where("n > 0").join(prints.where("k > 1"), "fp").where("a <> rep").select("a", F.col("rep").alias("b"))
    close = scratch.keep(close.union(same).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "close")
    members = scratch.keep(shared(bands_of(sig)), "members")
    wanted = members.select("a").union(close.select("x")).union(close.select("y")).distinct()
    texts = docs.select(F.xxhash64("text").alias("a"), "text").join(wanted, "a", "left_semi").groupBy("a").agg(F.min("text").alias("text"))
    texts = scratch.keep(texts, "texts")
    check = lambda pairs: verified(pairs, texts, width, threshold)
    known = scratch.keep(check(close), "known")
    groups = scratch.keep(linked(members, of_members(sig, members, scratch), check, scratch, known=known), "linked")
    comp = scratch.keep(nodes.select("a", "low").join(groups, "a", "left").select("a", "low", F.coalesce("root", "a").alias("root")), "comp")
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    scratch.keep_only("rows", "comp")
    return rows.select("doc_id", "key", "a").join(comp.join(lows, "root").select("a", "root", "component_id"), "a").select("doc_id", "key", "root", "component_id")
