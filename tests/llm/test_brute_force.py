"""Operators without SQL against plain, slow versions of their definitions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from noveltide.llm import decontam as D
from noveltide.llm import langid as G
from noveltide.llm import quality as Q

SF = "/root/testdata/sf0.001"


def longest(doc, item):
    """The longest stretch of the item, in any alignment, that begins and ends with an agreement and agrees in 80 %."""
    best, need = 0, min(D.LEAST, len(item))
    for offset in range(-len(item) + 1, len(doc)):
        same = [0 <= offset + k < len(doc) and doc[offset + k] == item[k] for k in range(len(item))]
        inside = [0 <= offset + k < len(doc) for k in range(len(item))]
        for i in range(len(item)):
            agree = 0
            for j in range(i, len(item)):
                if not inside[j] or not same[i]:
                    break
                agree += same[j]
                if same[j] and j - i + 1 >= need and agree >= D.SHARE * (j - i + 1):
                    best = max(best, j - i + 1)
    return best


@pytest.mark.parametrize("most", [D.MOST_SEEDS, 0])
def test_decontamination(spark, most):
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [[word() for _ in range(rnd.randint(5, 24))] for _ in range(12)]
    docs = []
    for _ in range(40):
        w = [word() for _ in range(rnd.randint(5, 60))]
        if rnd.random() < 0.8:
            part = list(rnd.choice(items))
            part = part[rnd.randrange(4) :]
            for _ in range(rnd.randrange(5)):
                part[rnd.randrange(len(part))] = word()
            at = rnd.randrange(len(w))
            w[at:at] = part
        docs.append(w)
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r["items"]), r.overlap_tokens) for r in D.contamination(spark, rows, bench, most_seeds=most).collect()}
    for k, w in enumerate(docs):
        found = {i: n for i, item in enumerate(items) if (n := longest(w, item))}
        assert got[k] == (bool(found), sorted(found), max(found.values(), default=0)), k


def rank_order(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << (21 * (len(x[0]) - 1 - k)) for k, c in enumerate(x[0]))))][: G.TOP]


def gram_counts(text):
    s = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    if len(s) <= 2:
        return Counter()
    grams = [s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)]
    return Counter(g for g in grams if not (len(g) != 2 and g[len(g) // 2] == " "))


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    train = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            train.setdefault(r.lang, Counter()).update(gram_counts(r.text))
    profiles = {lang: {g: k for k, g in enumerate(rank_order(c))} for lang, c in train.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(spark, docs).collect()}
    for r in rows:
        own = rank_order(gram_counts(r.text or ""))
        if not own:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else G.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id][0] == best and got[r.doc_id][1] == pytest.approx(1 - far[best] / (G.TOP * len(own)), abs=1e-12)


def test_word_vectors_and_network(spark):
    texts = ["one two two three. ONE!", "three two one 12 ...", "", None, "two Two two_three"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names = Q._vocabulary(df)
    words = Q.Words(names)
    vectors = Q._word_vectors(df, words, names)
    at = lambda t: words.row.get(t, words.row.get(Q.shape(t), words.rest))
    want = np.zeros((len(names) + 1, Q.WIDTH))
    base = [Q.index_vector(w) for w in names] + [np.zeros(Q.WIDTH)]
    for t in texts:
        ids = [at(x) for x in Q.tokens(t)]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= Q.WINDOW:
                    want[a] += base[b]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors[:, : Q.WIDTH], want / np.where(norm > 0, norm, 1)) and np.allclose(vectors[:, Q.WIDTH :], base)
    ids = [at(x) for x in Q.tokens(texts[0])]
    assert np.allclose(Q.pooled(words, vectors, texts[0]), np.mean([vectors[i] for i in ids], axis=0))
    assert not Q.pooled(words, vectors, None).any()
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(int)
    p = Q.train_network(x, y)
    by_hand = [float(np.tanh(((r - p["mean"]) / p["sd"]) @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]) / p["temperature"][0] for r in x]
    assert np.allclose(Q.logits(p, x), by_hand)
    chance = 1 / (1 + np.exp(-np.array(by_hand)))
    assert ((chance > 0.5) == y).mean() > 0.8 and abs(chance.mean() - y.mean()) < 0.1
