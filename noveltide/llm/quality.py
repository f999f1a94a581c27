"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Fitting uses a bounded sample of the labelled training rows (about ``ROWS`` of them, chosen by a hash of doc_id):

1. Tokens are runs of letters, of digits or of signs; a repeat of the token before is marked by one more. The sample's ``VOCABULARY`` most frequent tokens are words of
   their own; every other token stands as its shape (signs by their first sign, letters by their case).
2. Each word has a fixed sparse random index vector; a word's vector is the sum of the index vectors of its
   neighbours within ``WINDOW``, over the sample, scaled to unit length, next to its own index vector.
3. A document is the mean of its words' vectors. A two-layer network is trained on these means, on nine tenths
   of the sample.
4. A temperature is fitted on the other tenth, by the likelihood of its labels.

Scoring reads whole texts. A null or empty text has the zero vector and so a fixed score. Rows with null labels
do not train; a doc_id with several labels trains on their majority (1 where equal). With labels of one class only,
every score is that class's smoothed share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, beside

ROWS, VOCABULARY, WIDTH, WINDOW, HIDDEN, PARTS = 8000, 4096, 64, 2, 32, 8
AGAIN = "<again>"
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens(text: str | None) -> list[str]:
    """A text's tokens; one that repeats the token before it is followed by AGAIN."""
    got = TOKEN.findall(text) if text else []
    out = got[:1]
    for a, b in zip(got, got[1:]):
        out.append(b)
        if a == b:
            out.append(AGAIN)
    return out


def shape(token: str) -> str:
    if token == AGAIN:
        return AGAIN
    if token[0].isalpha():
        return "<upper>" if len(token) > 1 and token.isupper() else "<title>" if token[0].isupper() else "<lower>"
    return "<digits>" if token[0].isdigit() else "<signs" + token[0] * min(len(token), 3) + ">"


def index_vector(word: str) -> np.ndarray:
    """Eight signs at places drawn from the word's hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11))
    v = np.zeros(WIDTH)
    v[rng.choice(WIDTH, 8, replace=False)] = rng.choice([-1.0, 1.0], 8)
    return v / np.sqrt(8)


class Words:
    """Token to row: known words, then shapes, the last row for shapes never met."""

    def __init__(self, names: list[str]):
        self.row = {w: k for k, w in enumerate(names)}
        self.rest = len(names)

    def ids(self, text: str | None) -> np.ndarray:
        get, out = self.row.get, []
        for t in tokens(text):
            k = get(t)
            out.append(get(shape(t), self.rest) if k is None else k)
        return np.array(out, np.int64)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _vocabulary(sample: DataFrame) -> list[str]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            c: Counter = Counter()
            for t in x["text"]:
                got = tokens(t)
                c.update(got)
                c.update(map(shape, got))
            yield pd.DataFrame(c.items(), columns=["word", "n"])

    sums = sample.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in sums.where("n >= 5").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]


def _word_vectors(sample: DataFrame, words: Words, names: list[str]) -> np.ndarray:
    base = np.stack([index_vector(w) for w in names] + [np.zeros(WIDTH)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(base)
        for x in batches:
            for t in x["text"]:
                ids = words.ids(t)
                v = base[ids]
                for k in range(1, WINDOW + 1):
                    if len(ids) > k:
                        np.add.at(total, ids[k:], v[:-k])
                        np.add.at(total, ids[:-k], v[k:])
        yield pd.DataFrame({"total": [total.tobytes()]})

    sums = sum(np.frombuffer(r[0]).reshape(base.shape) for r in sample.select("text").coalesce(PARTS).mapInPandas(run, "total binary").collect())
    size = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.concatenate((sums / np.where(size > 0, size, 1), base), 1)


def pooled(words: Words, vectors: np.ndarray, text: str | None) -> np.ndarray:
    ids = words.ids(text)
    if not len(ids):
        return np.zeros(vectors.shape[1])
    n = np.bincount(ids, minlength=len(vectors))
    at = np.nonzero(n)[0]
    return n[at] @ vectors[at] / len(ids)


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 150) -> dict[str, np.ndarray]:
    """Weights of tanh and logistic layers (Adam, mini-batches), input scaling and temperature."""
    rng = np.random.default_rng(seed)
    part = rng.random(len(x)) < 0.1
    if y[part].min(initial=1) == y[part].max(initial=0) or len(set(y[~part])) < 2:
        part = np.zeros(len(x), bool)
    mean, sd = x[~part].mean(0), x[~part].std(0) + 1e-6
    z, t = (x - mean) / sd, y.astype(float)
    p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    rows = np.nonzero(~part)[0]
    for _ in range(epochs):
        rng.shuffle(rows)
        for k in range(0, len(rows), 256):
            b = rows[k : k + 256]
            h = np.tanh(z[b] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - t[b]) / len(b)
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            g = {"w1": z[b].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                p[n] -= 0.003 * m[n] / (1 - 0.9**step) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    p |= {"mean": mean, "sd": sd, "temperature": np.ones(1)}
    check = part if part.any() else ~part
    s = logits(p, x[check])
    grid = np.geomspace(0.5, 20, 80)
    loss = [np.logaddexp(0, np.where(y[check] == 1, -s, s) / g).mean() for g in grid]
    p["temperature"] = np.array([grid[int(np.argmin(loss))]])
    return p


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - p["mean"]) / p["sd"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]) / p.get("temperature", 1.0)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = ROWS):
    """(words, vectors, weights), or a float where the labels are of one class or none."""
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    given = given.where(~held_out(F.col("doc_id")))
    n = given.count()
    if not n:
        return 0.5
    picked = given.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) <= int(min(1.0, rows / n) * (1 << 30)))
    scratch = Scratch(spark, "quality")
    # at most about `rows` ids: a proven bound for the broadcast
    sample = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").repartition(PARTS), "sample")
    names = _vocabulary(sample)
    words = Words(names)
    vectors = _word_vectors(sample, words, names)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"y": x["y"], "doc_id": x["doc_id"], "v": [pooled(words, vectors, t) for t in x["text"]]})

    got = sample.mapInPandas(pool, "y int, doc_id long, v array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    return words, vectors, train_network(np.array(got["v"].tolist()), y)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.3, prefix: str = "") -> DataFrame:
    """``docs`` plus ``{prefix}held_out``, ``{prefix}score`` (chance of label 1) and ``{prefix}predicted``."""
    m = fit(spark, docs, labels)  # travels with the tasks: a few MB whatever the input, VOCABULARY x 2 WIDTH

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            if isinstance(m, float):
                yield pd.Series(np.full(len(x), m))
            else:
                s = logits(m[2], np.array([pooled(m[0], m[1], t) for t in x]).reshape(len(x), m[1].shape[1]))
                yield pd.Series(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    value = F.struct(F.pandas_udf(run, "double")("text").alias("score"))
    out = beside(docs, value, {"score": f"{prefix}score"}, **{f"{prefix}held_out": held_out(F.col("doc_id"))})
    names = [c for c in out.columns if c.lower() != f"{prefix}predicted".lower()]
    return out.select(*[F.col(f"`{c}`") for c in names], (F.col(f"`{prefix}score`") >= cut).cast("int").alias(f"{prefix}predicted"))
