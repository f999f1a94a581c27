"""Benchmark decontamination by spaced-seed hashing.

Texts become word tokens (letters, digits and underscores of the lower-cased text). A seed is a window of ``SPAN``
tokens seen through a fixed mask that ignores some positions, so that substituted tokens there do not hide the
match. Seeds of training texts and of benchmark items are joined by mask and hash of the tokens selected. Each hit
gives an alignment (document, item, offset); the tokens around it are compared one by one, and the overlap counts
when it spans at least min(``LEAST``, length of the item) tokens of which ``SHARE`` agree.

Items too short for a seed are found by their whole token sequence. Documents with null or empty text are clean;
null items match nothing. Repeated rows get the same result each; an empty table gives an empty table, an empty benchmark
leaves all clean. Benchmark rows that share an item_id are searched one by one, under a key of the row. Of overlaps of
one length the items are all listed. Other columns pass through; one with the name of a result is replaced by it.

The benchmark side is joined inside the scan while its seeds and its items number at most ``MOST_SEEDS`` each (counted
first); beyond that seeds of both sides meet in a shuffled join. Both ways run the same hashing and verification.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, beside, unpacked, whole_row

#: The masks, 1 for a token that is compared, and the lengths of the items that need them. A stretch of
#: n tokens with e of them changed, all inside, has n - e others in at most e + 1 runs. With e <= n / 5 one run has four
#: tokens or more, save for n = 15 and 7 (runs of three: two of them side by side) and 10, 11, 6 and 5, which the other
#: masks cover. So no overlap that qualifies is without a seed.
MASKS = ("1111", "1110111", "111011", "110111", "11011", "11101", "10111")
NEEDED = (range(4, 1 << 31), range(7, 1 << 31), (6, 10), (6,), (5,), (5,), (5,))
LEAST, SHARE, MOST_SEEDS = 13, 0.8, 2_000_000
WORD = re.compile(r"\w+")
#: Odd multipliers that spread the token hashes of a window.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"%d" % k) | 1 for k in range(max(map(len, MASKS)))], np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes(tokens: list[str], known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit token hashes; with ``known``, zero for tokens it lacks."""
    if known is not None:
        get = known.get
        return np.array([get(t, 0) for t in tokens], np.uint64)
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) | 1 for t in tokens], np.uint64)


def seeds(h: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of the windows under mask ``at`` whose selected tokens are all non-zero."""
    picked = [k for k, c in enumerate(MASKS[at]) if c == "1"]
    n = len(h) - len(MASKS[at]) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = h != 0
    ok = np.ones(n, bool)
    for k in picked:
        ok &= full[k : k + n]
    pos = np.nonzero(ok)[0]
    out = np.full(len(pos), at + 1, np.uint64)
    for k in picked:
        out = (out ^ (h[pos + k] * MULTIPLIERS[k])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return pos, out.view(np.int64)


def overlap(doc: np.ndarray, item: np.ndarray, offset: int, at: int, least: int = LEAST, share: float = SHARE) -> tuple[int, int]:
    """The longest stretch [i, j) of the item, around token ``at``, that agrees with the document at ``offset`` in
    ``share`` of its tokens and begins and ends with an agreement; (0, 0) if it is shorter than wanted."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    same = doc[offset + lo : offset + hi] == item[lo:hi]
    # with weights (1 - share) for an agreement and -share for a difference, a stretch qualifies when its sum is >= 0
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - share, -share))))
    begin = np.nonzero(same[: at - lo + 1])[0]
    end = at - lo + 1 + np.nonzero(np.concatenate((same[at - lo :], [False]))[:-1])[0]
    if not len(begin) or not len(end):
        return 0, 0
    best = (0, 0)
    for i in begin:  # benchmark items are short; a long one is bounded by its length squared only in agreement runs
        j = end[total[end] - total[i] >= -1e-9]
        if len(j) and j[-1] - i > best[1] - best[0]:
            best = (int(i), int(j[-1]))
        if best[1] - best[0] >= end[-1] - i:
            break
    need = min(least, len(item))
    return (best[0] + lo, best[1] + lo) if best[1] - best[0] >= need else (0, 0)


def masks_used(lengths: Iterable[int]) -> list[int]:
    lengths = set(lengths)
    return [k for k, n in enumerate(NEEDED) if any(x in n for x in lengths)]


def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"n": [len(words(t)) for t in x["text"]]}, dtype=np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, pos), item being the row's key: the benchmark side; items shorter than a mask have their whole sequence as one seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for item, text in zip(x["key"], x["text"]):
                h = hashes(words(text))
                for at in (k for k, n in enumerate(NEEDED) if len(h) in n):
                    out += [(s, item, p) for p, s in zip(*map(np.ndarray.tolist, seeds(h, at)))]
            yield pd.DataFrame(out, columns=["seed", "item", "pos"]).astype({"pos": "int32"})

    return items.mapInPandas(run, "seed long, item long, pos int")


def verified(doc: np.ndarray, hits: set[tuple[int, int, int]], items: dict[int, np.ndarray]) -> dict[int, int]:
    """{item: tokens of its longest verified overlap} for hits (item, offset, place in the item)."""
    out: dict[int, int] = {}
    done: dict[tuple[int, int], int] = {}
    for item, offset, at in sorted(hits):
        if at < done.get((item, offset), 0):
            continue  # inside a stretch that has been measured
        i, j = overlap(doc, items[item], offset, at)
        done[item, offset] = max(j, at + 1)
        if j > i:
            out[item] = max(out.get(item, 0), j - i)
    return out


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, most_seeds: int = MOST_SEEDS, prefix: str = "") -> DataFrame:
    """``docs`` plus ``{prefix}contaminated``, ``{prefix}items`` (ids, ascending) and ``{prefix}overlap_tokens`` (the longest)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    items = items.withColumn("key", F.xxhash64("item_id", "text"))
    bench = item_seeds(items)
    # items without a seed, which are short, count as well
    if bench.limit(most_seeds + 1).count() > most_seeds or items.limit(most_seeds + 1).count() > most_seeds:
        return _shuffled(spark, docs, items, bench, prefix)
    found = bench.toPandas()
    order = np.lexsort((found["pos"], found["item"], found["seed"]))
    seed, item, pos = (found[c].to_numpy()[order] for c in ("seed", "item", "pos"))
    rows = [(r.key, r.item_id, words(r.text)) for r in items.toLocalIterator()]
    texts, ids = {k: w for k, _, w in rows}, {k: i for k, i, _ in rows}
    known = {t: int(h) for w in texts.values() for t, h in zip(w, hashes(w).tolist())}
    used = masks_used(map(len, texts.values()))
    tokens = {k: hashes(w, known) for k, w in texts.items()}
    short: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for k, h in sorted(tokens.items()):
        if 0 < len(h) < len(MASKS[0]):
            short.setdefault(len(h), {}).setdefault(tuple(h.tolist()), []).append(k)

    def one(text: str | None) -> tuple[bool, list[int], int]:
        h = hashes(words(text), known)
        hits: set[tuple[int, int, int]] = set()
        for at in used:
            p, s = seeds(h, at)
            lo, hi = np.searchsorted(seed, s), np.searchsorted(seed, s, "right")
            for k in np.nonzero(hi > lo)[0].tolist():
                hits.update((int(item[m]), int(p[k] - pos[m]), int(pos[m])) for m in range(lo[k], hi[k]))
        out = verified(h, hits, tokens)
        for n, whole in short.items():
            ok = np.ones(max(0, len(h) - n + 1), bool)
            for k in range(n):
                ok &= h[k : k + len(ok)] != 0
            for p in np.nonzero(ok)[0].tolist():
                for k in whole.get(tuple(h[p : p + n].tolist()), ()):
                    out[k] = n
        return bool(out), sorted({ids[k] for k in out}), max(out.values(), default=0)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([one(t) for t in x], columns=["contaminated", "items", "overlap_tokens"])

    scan = F.pandas_udf(run, "contaminated boolean, items array<long>, overlap_tokens long")
    return beside(docs, scan(F.col("text")), {c: prefix + c for c in ("contaminated", "items", "overlap_tokens")})


def _shuffled(spark: SparkSession, docs: DataFrame, items: DataFrame, bench: DataFrame, prefix: str) -> DataFrame:
    """For a benchmark too large to send to every task: seeds meet in an equi-join, and each hit's surroundings travel with it."""
    scratch = Scratch(spark, "decontam")
    used = masks_used(r[0] for r in items.mapInPandas(sizes, "n long").distinct().toLocalIterator())
    keyed = docs.select("text").where("text is not null").distinct().withColumn("__t", F.xxhash64("text"))

    def doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for t, text in zip(x["__t"], x["text"]):
                h = hashes(words(text))
                for at in used:
                    p, s = seeds(h, at)
                    if len(p):
                        yield pd.DataFrame({"t": t, "seed": s, "dpos": p.astype(np.int32)})

    def item_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"item": x["key"], "id": x["item_id"], "itokens": [hashes(words(t)).view(np.int64) for t in x["text"]]})

    seeds_met = keyed.mapInPandas(doc_seeds, "t long, seed long, dpos int").join(bench, "seed")
    met = scratch.keep(seeds_met.select("t", "item", (F.col("dpos") - F.col("pos")).alias("off"), "pos").distinct(), "met")
    wanted = keyed.join(met.select(F.col("t").alias("__t")).distinct(), "__t", "left_semi")
    pairs = met.groupBy("t", "item").agg(F.collect_set(F.struct("off", "pos")).alias("hits"))
    pairs = pairs.join(items.mapInPandas(item_tokens, "item long, id long, itokens array<long>"), "item").join(wanted.withColumnRenamed("__t", "t"), "t")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t, item, name, hits, itokens, text in zip(x["t"], x["item"], x["id"], x["hits"], x["itokens"], x["text"]):
                got = verified(hashes(words(text)), {(item, r["off"], r["pos"]) for r in hits}, {item: np.asarray(itokens, np.int64).view(np.uint64)})
                rows += [(t, name, n) for n in got.values()]
            yield pd.DataFrame(rows, columns=["t", "item", "n"])

    got = pairs.select("t", "item", "id", "hits", "itokens", "text").mapInPandas(check, "t long, item long, n long")
    short = items.mapInPandas(item_tokens, "item long, id long, itokens array<long>").where((F.size("itokens") > 0) & (F.size("itokens") < len(MASKS[0])))
    lengths = [r[0] for r in short.select(F.size("itokens")).distinct().collect()]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for t, text in zip(x["__t"], x["text"]):
                h = hashes(words(text)).view(np.int64)
                for n in lengths:
                    if len(h) >= n:
                        yield pd.DataFrame({"t": t, "itokens": list(np.lib.stride_tricks.sliding_window_view(h, n))})

    if lengths:
        got = got.union(keyed.mapInPandas(whole, "t long, itokens array<long>").join(short, "itokens").select("t", F.col("id").alias("item"), F.size("itokens").cast("long").alias("n")).distinct())
    sums = got.groupBy("t").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("n").alias("n"))
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64("text").alias("t")).join(sums, "t", "left")
    hit = F.col("row.text").isNotNull() & F.col("items").isNotNull()
    found = {"contaminated": hit, "items": F.when(hit, F.col("items")).otherwise(F.array().cast("array<long>")), "overlap_tokens": F.when(hit, F.col("n")).otherwise(F.lit(0)).cast("long")}
    kept = unpacked([c for c in docs.columns if c.lower() not in {(prefix + n).lower() for n in found}])
    return rows.select(*kept, *[c.alias(prefix + n) for n, c in found.items()])
