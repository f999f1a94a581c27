"""LM scoring: stupid-backoff bigram scores from count tables partitioned by hash.

Tokens are the runs of characters other than blank and 0x09-0x0D, A-Z lower-cased. A token w after v (v: the token
before, or the document's begin) scores c(v w) / c(v ...), or ``ALPHA`` * c(w) / N where v w was never counted, or
``ALPHA`` / (N + 1) where w was not either; a document's score is the sum of the logarithms. Counts are taken from
``train``, by default the scored documents themselves, all of them and whole; then c(v w) and c(v ...) leave out the
row that is scored, so that a text is not its own model and bigrams that it alone holds back off.

Exploded bigrams are dealt to buckets by the hash of v, so that a bucket holds the count tables of its contexts and
the bigrams to be joined with them; both meet in one shuffle, packed by bucket and batch (tokens, runs of the
context, a document number), about 8 bytes a token: the ``CODES`` most frequent of the words of more than ``OFTEN`` of all
tokens travel as codes of two bytes, others as hashes. A bucket returns sums packed by slice of the input. Buckets are sized
by the corpus (``BUCKET`` tokens each).

Hot contexts (over ``BUCKET`` / 4 tokens and a ``SHARE`` of all, so at most 1 / SHARE of them) are counted beforehand
by a pre-aggregated sum; their bigrams are spread over all buckets by both words, with the row's own count of the
context. Hot bigrams (the same bounds) are counted likewise and scored inside the scan, so no bucket receives them. What
the driver gets is those hot counts, at most 3 / SHARE of them, and 1 / OFTEN counts of words.

What backs off to a word of more than ``OFTEN`` of all tokens (at most 1 / OFTEN of them, whose counts go with the tasks)
is scored in its bucket; other words meet the table of single words in a join by hash.

Null and empty texts have no tokens, a score of 0 and a null mean. Rows that share a doc_id (null included) are parts
of one document, scored each without itself and summed. Repeated rows are rows of their own, so copies know each other.
An empty table gives an empty table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

ALPHA, BUCKET, SHARE, OFTEN, SLICE, CODES = 0.4, 1_200_000, 1e-5, 2e-6, 6_000_000, 65_535
BEGIN = xxhash.xxh64_intdigest(b"begin of document", 1)


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches cut into runs of rows with about SLICE characters, which bounds what a task holds."""
    for x in batches:
        if len(x):
            part = np.cumsum([len(t) if t else 0 for t in x["text"]]) // SLICE
            cut = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(x)])).astype(int)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield x.iloc[i:j]


def token_hashes(text: str | None) -> np.ndarray:
    # digests are joined as bytes, which is cheaper than a Python number for each token
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, (text or "").encode("utf-8", "surrogatepass").lower().split())), ">u8").astype(np.uint64)


def contexts(w: np.ndarray) -> np.ndarray:
    return np.concatenate((np.array([BEGIN], np.uint64), w[:-1])) if len(w) else w


def mix(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    if b is not None:
        x = (x ^ (x >> np.uint64(31)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def flat(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The contexts and the words of all texts of a batch."""
    w = [token_hashes(t) for t in x["text"]]
    v = np.concatenate([contexts(t) for t in w] or [np.empty(0, np.uint64)])
    return v, np.concatenate(w or [np.empty(0, np.uint64)])


def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each hash is a context (n) and a word (c), by batch."""
    for x in slices(batches):
        v, w = flat(x)
        if not len(w):
            continue
        u, c = np.unique(w, return_counts=True)
        begin = np.nonzero(v == BEGIN)[0]
        # a word is a context wherever it is not the last of its text
        last, k = np.unique(w[np.append(begin[1:], len(w)) - 1], return_counts=True)
        of = c.copy()
        of[np.searchsorted(u, last)] -= k
        yield pd.DataFrame({"v": np.append(u, np.uint64(BEGIN)).view(np.int64), "n": np.append(of, len(begin)), "c": np.append(c, 0)})


def tallied_pairs(batches: Iterator[pd.DataFrame], first_in: np.ndarray, second_in: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counts of the bigrams whose words are in these, by batch."""
    for x in slices(batches):
        v, w = flat(x)
        keep = np.isin(v, first_in)
        v, w = v[keep], w[keep]
        keep = np.isin(w, second_in)
        order = np.lexsort((w[keep], v[keep]))
        v, w = v[keep][order], w[keep][order]
        first = np.nonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))[0] if len(v) else np.empty(0, np.int64)
        yield pd.DataFrame({"v": v[first].view(np.int64), "w": w[first].view(np.int64), "n": np.diff(np.append(first, len(v)))})


def unsigned(k: int) -> int:
    return int(np.int64(k).view(np.uint64))


class Hot:
    """Sorted arrays of hot contexts, bigrams and words with their counts, and the number of tokens."""

    def __init__(self, one: dict, two: dict, words: dict, total: int):
        self.total = max(1, total)
        self.word = np.array(sorted(words), np.uint64)
        self.word_n = np.array([words[int(k)] for k in self.word], np.int64)
        #: The words that travel as codes of two bytes, the most frequent ones.
        self.coded = np.array(sorted(sorted(words, key=words.get, reverse=True)[:CODES]), np.uint64)
        self.v = np.array(sorted(one), np.uint64)
        self.n = np.array([one[int(k)] for k in self.v], np.int64)
        a, b = (np.array([k[i] for k in two], np.uint64) for i in (0, 1))
        key = mix(a, b)
        by = np.argsort(key)
        self.key, self.first, self.second, self.count = key[by], a[by], b[by], np.array(list(two.values()), np.int64)[by]

    def context(self, v: np.ndarray) -> np.ndarray:
        """Counts of hot contexts, 0 for others."""
        if not len(self.v):
            return np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.v, v), len(self.v) - 1)
        return np.where(self.v[at] == v, self.n[at], 0)

    def single(self, w: np.ndarray) -> np.ndarray:
        """Counts of hot words, 0 for others."""
        if not len(self.word):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.word, w), len(self.word) - 1)
        return np.where(self.word[at] == w, self.word_n[at], 0)

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Codes of words from 1 on, 0 for those that have none."""
        if not len(self.coded):
            return np.zeros(len(w), np.uint16)
        at = np.minimum(np.searchsorted(self.coded, w), len(self.coded) - 1)
        return np.where(self.coded[at] == w, at + 1, 0).astype(np.uint16)

    def words(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The words of ``codes``, those that have none taken from ``rest`` in turn."""
        out = np.empty(len(codes), np.uint64)
        out[codes > 0] = self.coded[codes[codes > 0].astype(np.int64) - 1]
        out[codes == 0] = rest
        return out

    def bigram(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of hot bigrams, 0 for others."""
        if not len(self.key):
            return np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.key, mix(v, w)), len(self.key) - 1)
        return np.where((self.first[at] == v) & (self.second[at] == w), self.count[at], 0)


def own_counts(*keys: np.ndarray) -> np.ndarray:
    """How often each element's combination of keys occurs."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    by = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(by), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.diff(np.append(np.nonzero(new)[0], len(by)))[np.cumsum(new) - 1]
    return out


PACKED = "bucket int, slice long, docs binary, runs binary, v binary, w binary, rest binary, doc binary, own binary, counted boolean, scored boolean"
#: What a bucket returns, by slice: kind 0 has the slice's doc_ids; kind 1 documents (by number in the slice), sums and
#: counts; kind 2 the same of bigrams never counted, with token hashes for sums.
SUMMED = "slice long, kind int, docs binary, sums binary, counts binary"
SCORED = "doc_id long, score double, n long, w long"


def narrow(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    top = int(n.max(initial=0))
    return n.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def widened(b: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``narrow``."""
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(b) // n] if n else np.uint32).astype(np.int64)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def by_bucket(at: np.ndarray, v: np.ndarray, buckets: int) -> np.ndarray:
    """An order by bucket, then context, then place. Bucket, a context's first bits and the place fill one number, whose
    sort is far cheaper than one by two keys; contexts that share those bits may mix, which only makes more runs."""
    high, low = buckets.bit_length(), len(v).bit_length()
    if high + low > 40:
        return np.lexsort((v, at))
    key = at.astype(np.uint64) << np.uint64(64 - high) | v >> np.uint64(high + low) << np.uint64(low) | np.arange(len(v), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << low) - 1)).astype(np.int64)


def pack(batches: Iterator[pd.DataFrame], buckets: int, hot: Hot, counted: bool, scored: bool) -> Iterator[pd.DataFrame]:
    for x in slices(batches):
        ids = x["doc_id"].to_numpy()
        key = np.uint64(xxhash.xxh64_intdigest(ids.tobytes(), len(ids))).view(np.int64)
        w = [token_hashes(t) for t in x["text"]]
        doc = np.repeat(np.arange(len(w), dtype=np.uint32), [len(t) for t in w])
        v = np.concatenate([contexts(t) for t in w] or [np.empty(0, np.uint64)])
        w = np.concatenate(w or [np.empty(0, np.uint64)])
        spread, own_context = hot.context(v) > 0, np.zeros(len(v), np.int64)
        if counted and scored:
            own_context[spread] = own_counts(v[spread], doc[spread])
        rare = hot.bigram(v, w) == 0
        v, w, doc, spread, own_context = v[rare], w[rare], doc[rare], spread[rare], own_context[rare]
        at = (mix(v) % np.uint64(buckets)).astype(np.int32)
        at[spread] = (mix(v[spread], w[spread]) % np.uint64(buckets)).astype(np.int32)
        order = by_bucket(at, v, buckets)
        v, w, doc, at, spread, own_context = v[order], w[order], doc[order], at[order], spread[order], own_context[order]
        codes = hot.codes(w)
        cut = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0] if len(at) else np.empty(0, np.int64)
        out = []
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist()):
            first = np.nonzero(np.concatenate(([True], v[i + 1 : j] != v[i : j - 1])))[0]
            own, number = np.unique(doc[i:j], return_inverse=True)
            number = number.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
            of_spread = narrow(own_context[i:j][spread[i:j]])
            runs = narrow(np.diff(np.append(first, j - i)))
            out.append((int(at[i]), int(key), own.tobytes(), runs, v[i:j][first].tobytes(), codes[i:j].tobytes(), w[i:j][codes[i:j] == 0].tobytes(), number.tobytes(), of_spread, counted, scored))
        if scored:  # the slice's doc_ids travel once; elsewhere documents are numbered within the slice
            out.append((int(key) % buckets, int(key), ids.astype(np.int64).tobytes(), b"", b"", b"", b"", b"", b"", False, True))
        yield pd.DataFrame(out, columns=names(PACKED))


def scan_hot(batches: Iterator[pd.DataFrame], hot: Hot, leave_out: bool) -> Iterator[pd.DataFrame]:
    """The scores of hot bigrams, by document; those that no other document holds back off."""
    for x in batches:
        out = []
        for d, t in zip(x["doc_id"], x["text"]):
            w = token_hashes(t)
            v = contexts(w)
            two, one = hot.bigram(v, w), hot.context(v)
            if (at := two > 0).any():
                if leave_out:
                    two, one = two - own_counts(v, w), one - own_counts(v)
                ok = at & (two > 0)
                out.append((d, float((np.log(two[ok]) - np.log(one[ok])).sum()), int(ok.sum()), None))
                u, n = np.unique(w[at & ~ok], return_counts=True)
                out += [(d, 0.0, k, h) for h, k in zip(u.view(np.int64).tolist(), n.tolist())]
        d, s, n, w = zip(*out) if out else ((), (), (), ())  # hashes beside nulls must not become floats
        yield pd.DataFrame({"doc_id": pd.array(d, "Int64"), "score": np.array(s, float), "n": np.array(n, np.int64), "w": pd.array(w, "Int64")})


def join_bucket(x: pd.DataFrame, hot: Hot) -> pd.DataFrame:
    """One bucket: count its bigrams and contexts, look up the scored ones, add up by slice and document."""
    full = x["w"].str.len() > 0
    out = [(int(r.slice), 0, r.docs, b"", b"") for r in x[~full].itertuples(index=False)]  # doc_ids of slices
    x = x[full]
    v, w, at, own, counted, scored, docs, base = [], [], [], [], [], [], [], [0]
    for r in x.itertuples(index=False):
        context = np.repeat(np.frombuffer(r.v, np.uint64), widened(r.runs, len(r.v) // 8))
        docs.append(np.frombuffer(r.docs, np.uint32))
        v.append(context)
        spread, of_spread = hot.context(context) > 0, np.zeros(len(context), np.int64)
        if spread.any():
            of_spread[spread] = widened(r.own, int(spread.sum()))
        own.append(of_spread)
        w.append(hot.words(np.frombuffer(r.w, np.uint16), np.frombuffer(r.rest, np.uint64)))
        at.append(base[-1] + np.frombuffer(r.doc, np.uint16 if len(r.doc) == 2 * len(context) else np.uint32).astype(np.int64))
        counted.append(np.full(len(context), r.counted))
        scored.append(np.full(len(context), r.scored))
        base.append(base[-1] + len(docs[-1]))
    if len(x):
        v, w, at, own, counted, scored, docs = map(np.concatenate, (v, w, at, own, counted, scored, docs))
        order = np.lexsort((w, v))
        v, w, at, own, counted, scored = v[order], w[order], at[order], own[order], counted[order], scored[order]
        new_v = np.concatenate(([True], v[1:] != v[:-1]))
        group_v, group = np.cumsum(new_v) - 1, np.cumsum(new_v | np.concatenate(([True], w[1:] != w[:-1]))) - 1
        two = np.bincount(group, counted)[group]
        both, one = counted & scored, np.bincount(group_v, counted)[group_v]
        hot_one = hot.context(v)
        if both.any():  # a row is scored by the counts of the others
            two[both] -= own_counts(group[both] * len(docs) + at[both])
            one[both] -= own_counts(group_v[both] * len(docs) + at[both])
        one = np.where(hot_one > 0, hot_one - own, one)
        ok = scored & (two > 0)
        gain, left = np.zeros(len(v)), scored & (two == 0)
        gain[ok] = np.log(two[ok]) - np.log(one[ok])
        c = np.where(left, hot.single(w), 0)
        gain[c > 0] = np.log(ALPHA * c[c > 0] / hot.total)
        ok |= c > 0
        left &= c == 0
        sums = np.bincount(at[ok], gain[ok], len(docs))
        counts = np.bincount(at[ok], minlength=len(docs)).astype(np.uint32)
        out += [(int(k), 1, docs[i:j].tobytes(), sums[i:j].tobytes(), narrow(counts[i:j])) for k, i, j, s in zip(x["slice"], base[:-1], base[1:], x["scored"]) if s]
        if left.any():
            part = np.searchsorted(base, at[left], "right") - 1
            more = pd.DataFrame({"slice": x["slice"].to_numpy()[part], "d": docs[at[left]], "w": w[left].view(np.int64)})
            more = more.groupby(["slice", "d", "w"]).size().reset_index(name="n")
            out += [(int(k), 2, g["d"].to_numpy(np.uint32).tobytes(), g["w"].to_numpy(np.int64).tobytes(), narrow(g["n"].to_numpy(np.uint32))) for k, g in more.groupby("slice")]
    return pd.DataFrame(out, columns=names(SUMMED))


def add_up(x: pd.DataFrame) -> pd.DataFrame:
    """One slice: its documents' sums over all buckets, and by row what backs off."""

    def joined(kind: int, column: str, type_) -> np.ndarray:
        return np.concatenate([np.frombuffer(b, type_) for b in x.loc[x["kind"] == kind, column]] or [np.empty(0, type_)])

    def counted(kind: int) -> np.ndarray:
        rows = x.loc[x["kind"] == kind]
        return np.concatenate([widened(b, len(d) // 4) for b, d in zip(rows["counts"], rows["docs"])] or [np.empty(0, np.int64)])

    ids = np.frombuffer(x.loc[x["kind"] == 0, "docs"].iloc[0], np.int64)
    at = joined(1, "docs", np.uint32)
    sums, counts = np.bincount(at, joined(1, "sums", np.float64), len(ids)), np.bincount(at, counted(1), len(ids)).astype(np.int64)
    out = pd.DataFrame({"doc_id": ids, "score": sums, "n": counts, "w": pd.array([None] * len(ids), "Int64")})
    if (x["kind"] == 2).any():
        rest = {"doc_id": ids[joined(2, "docs", np.uint32)], "score": 0.0, "n": counted(2), "w": pd.array(joined(2, "sums", np.int64), "Int64")}
        out = pd.concat([out, pd.DataFrame(rest)])
    return out


#: Stands for a null doc_id inside the packed rows.
NULL_DOC = -(1 << 63)


def score(spark: SparkSession, docs: DataFrame, train: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per doc_id: doc_id, n_tokens, log_score, mean_log_score."""
    scratch = Scratch(spark, "lm")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC))
    texts = docs.select(key.alias("doc_id"), "text")
    corpus = texts if train is None else train.select(F.lit(0).cast("long").alias("doc_id"), "text")
    # one scan counts contexts and words
    table = scratch.keep(corpus.mapInPandas(tallied, "v long, n long, c long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    total = table.agg(F.sum("c")).first()[0] or 0
    least = max(bucket // 4, int(total * SHARE))
    one = {unsigned(v): n for v, n in table.where(F.col("n") > least).select("v", "n").collect()}
    two = {}
    if one:
        # a bigram is not more frequent than its words
        only, last = np.array(sorted(one), np.uint64), np.array([unsigned(r[0]) for r in table.where(F.col("c") > least).select("v").collect()], np.uint64)
        pairs = corpus.mapInPandas(lambda b: tallied_pairs(b, only, last), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
        two = {(unsigned(v), unsigned(w)): n for v, w, n in pairs.where(F.col("n") > least).collect()}
    single = table.where("c > 0").select(F.col("v").alias("w"), "c")
    often = {unsigned(w): c for w, c in single.where(F.col("c") > int(total * OFTEN)).collect()}
    scratch.release(wait=1)
    hot, buckets = Hot(one, two, often, total), max(1, -(-total // bucket))
    own = train is None
    packed = corpus.mapInPandas(lambda b: pack(b, buckets, hot, True, own), PACKED)
    if train is not None:
        packed = packed.union(texts.mapInPandas(lambda b: pack(b, buckets, hot, False, True), PACKED))
    got = packed.groupBy("bucket").applyInPandas(lambda x: join_bucket(x, hot), SUMMED)
    parts = got.groupBy("slice").applyInPandas(add_up, SCORED)
    parts = scratch.keep(parts, "parts")
    scratch.release(wait=1)
    if two:
        parts = parts.union(texts.mapInPandas(lambda b: scan_hot(b, hot, own), SCORED))

    # what else backs off meets the table of single words
    low = parts.where("w is not null").select("doc_id", "w", "n").join(single, "w", "left")
    gain = F.when(F.col("c").isNull(), F.lit(float(np.log(ALPHA / (total + 1))))).otherwise(F.log(F.lit(ALPHA) * F.col("c") / F.lit(max(1, total))))
    low = low.select("doc_id", (gain * F.col("n")).alias("score"), "n")
    sums = parts.where("w is null").select("doc_id", "score", "n").union(low).groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
    out = texts.select("doc_id").distinct().join(sums, "doc_id", "left")
    n, s = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("score", F.lit(0.0))
    return out.select(F.when(F.col("doc_id") != NULL_DOC, F.col("doc_id")).alias("doc_id"), n.alias("n_tokens"), s.alias("log_score"), F.when(n > 0, s / n).alias("mean_log_score"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT doc_id, unnest(ws) AS w, unnest(list_concat([''], ws[:-2])) AS v FROM t WHERE len(ws) > 0),
k AS (SELECT doc_id, count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
  count(*) OVER (PARTITION BY v) - count(*) OVER (PARTITION BY doc_id, v) AS c1, count(*) OVER (PARTITION BY w) AS c0, count(*) OVER () AS n FROM b),
c AS (SELECT doc_id, CASE WHEN c2 > 0 THEN ln(c2) - ln(c1) ELSE ln(0.4::DOUBLE * c0 / n) END AS s FROM k),
d AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM c GROUP BY doc_id)
SELECT i.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(s, 0.0), 4)::DOUBLE AS log_score, round(s / n, 6)::DOUBLE AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) i LEFT JOIN d ON i.doc_id IS NOT DISTINCT FROM d.doc_id
"""
