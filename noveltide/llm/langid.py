"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is a language's ``TOP`` most frequent character n-grams (1 to 3 letters, words marked by a blank at
either end), in order. A document is compared, by its own most frequent n-grams, with each profile: an n-gram
counts the difference of its two ranks, one that the profile lacks counts ``TOP``. The language with the smallest
sum wins, the first by name among equals.

Profiles are fitted on a bounded sample of the labelled training rows: about ``PER_LANG`` documents a language,
chosen by a hash of doc_id. Prediction reads whole texts. Text that is null or has no letter gets ``und`` with
score 0; otherwise score is 1 - distance / (largest possible distance), between 0 and 1. With no training rows
every text is ``und``. Repeated rows get the same result each; an empty table gives an empty table. A column with the
name of a result is replaced by it, others pass through. A null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, give_back

TOP, PER_LANG, PIECE, MOST_SENT = 400, 2000, 1 << 20, 10_000
OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as packed longs (21 bits a character), ascending, and their counts."""
    s = " " + OTHER.sub(" ", text.lower()).strip() + " " if text else "  "
    if len(s) <= 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, counts = [], []
    for k in range(0, len(s), PIECE):  # pieces overlap by two characters so that each n-gram is met once
        c = np.frombuffer(s[max(0, k - 2) : k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        old = min(k, 2)
        blank = c == 32
        one = c[old:][~blank[old:]]
        at = max(old - 1, 0)
        two = ((c[:-1] << 21) | c[1:])[at:]
        three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        three = three[~blank[1:-1]]
        u, n = np.unique(np.concatenate((one, two, three)), return_counts=True)
        keys.append(u)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent keys, most frequent first, the smaller key among equals."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:top]


def train_profiles(rows: DataFrame, per_lang: int = PER_LANG, top: int = TOP) -> dict[str, list[int]]:
    """{language: packed n-grams in order} from (doc_id, text, lang); null texts and languages are left out."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a share of the hash's range, in doubles, which no number of rows overflows
    share = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = sizes.limit(MOST_SENT + 1).count() <= MOST_SENT  # the sizes are sent to the scan only where they are few
    picked = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(share * F.col("n") < float(per_lang))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for lang, part in x.groupby("lang"):
                got = [grams(t) for t in part["text"]]
                u, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": u, "n": np.bincount(back, np.concatenate([g[1] for g in got]), len(u)).astype(np.int64)})

    sums = picked.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(map(tuple, best.select("lang", "gram", "r").collect()), key=lambda x: (x[0], x[2])):
        out.setdefault(lang, []).append(gram)
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP, prefix: str = "") -> DataFrame:
    """``docs`` plus ``{prefix}lang_pred`` and ``{prefix}score``."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in names])) if names else np.empty(0, np.int64)
    rank = np.full((len(known) + 1, max(1, len(names))), -1, np.int32)
    for k, x in enumerate(names):
        rank[np.searchsorted(known, np.array(profiles[x], np.int64)), k] = np.arange(len(profiles[x]))

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), top)
        if not len(own) or not names:
            return "und", 0.0
        at = np.searchsorted(known, own)
        at[(at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        r = rank[at]
        far = np.where(r < 0, top, np.abs(r - np.arange(len(own), dtype=np.int32)[:, None])).sum(0)
        k = int(far.argmin())
        return names[k], float(1 - far[k] / (top * len(own)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([one(t) for t in x], columns=["lang_pred", "score"])
            del x
        give_back()

    guess = F.pandas_udf(run, "lang_pred string, score double")
    return beside(docs, guess(F.col("text")), {"lang_pred": f"{prefix}lang_pred", "score": f"{prefix}score"})


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` plus held_out, lang_pred and score; learns from the labelled rows that are not held out."""
    docs = docs.withColumn(f"{prefix}held_out", held_out(F.col("doc_id")))
    profiles = train_profiles(docs.where(~F.col(f"{prefix}held_out")).select("doc_id", "text", "lang"))
    return predict(docs, profiles, prefix=prefix)
