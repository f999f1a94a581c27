import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noveltide.llm import decontam as D
from noveltide.llm import langid as G
from noveltide.llm import lm_score as M
from noveltide.llm import quality as Q

DOC = "doc_id long, text string, lang string"


# --- decontamination


def passage(n=30, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def contaminated(spark, texts, items, **kw):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: (r.x_contaminated, list(r.x_items), r.x_overlap_tokens) for r in D.contamination(spark, docs, bench, prefix="x_", **kw).collect()}


@pytest.mark.parametrize("most", [D.MOST_SEEDS, 0])
def test_decontamination(spark, most):
    p, q = passage(), passage(40, 2)
    other = " ".join(passage(200, 3))
    changed = list(p)
    for k in (4, 11, 17, 23):
        changed[k] = "zzz"
    half = p[:15]
    texts = [
        f"{other} {' '.join(p)} {other}", f"{other} {' '.join(changed).upper()}, {other}", f"{' '.join(half)}", f"{' '.join(p[:9])} {other}", other, None, "", " ".join(q) + ". " + " ".join(p),
        "x one two three y", "one three two", "word " * 20_000 + " ".join(p),
    ]
    got = contaminated(spark, texts, [" ".join(p), " ".join(q), None, "", "one two three"], most_seeds=most)
    assert got[0] == (True, [0], 30) and got[1] == (True, [0], 30) and got[2] == (True, [0], 15)
    assert not got[3][0] and not got[4][0] and got[5] == (False, [], 0) and got[6] == (False, [], 0)
    assert got[7] == (True, [0, 1], 40) and got[8] == (True, [4], 3) and not got[9][0] and got[10][0]


@pytest.mark.parametrize("most", [D.MOST_SEEDS, 0])
def test_decontamination_takes_every_hit_and_item_row(spark, most):
    p, q = passage(43, 5), passage(30, 6)
    apart = p[:8] + ["zzz"] * 22 + p[30:]
    docs = spark.createDataFrame([(1, " ".join(apart)), (2, " ".join(q)), (3, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(p)), (1, " ".join(q)), (1, " ".join(passage(30, 7))), (1, "one two")], "item_id long, text string")
    got = {r.doc_id: (list(r["items"]), r.overlap_tokens) for r in D.contamination(spark, docs, bench, most_seeds=most).collect()}
    assert got == {1: ([0], 13), 2: ([1], 30), 3: ([1], 2)}


def test_every_qualifying_substitution_has_a_seed():
    for n in range(1, 17):
        h = np.arange(1, n + 1, dtype=np.uint64)
        used = [k for k, x in enumerate(D.NEEDED) if n in x]
        known = {k: set(zip(*map(np.ndarray.tolist, D.seeds(h, k)))) for k in used}
        for e in range(n // 5 + 1):
            for places in itertools.combinations(range(1, n - 1), e):
                g = h.copy()
                g[list(places)] = 999
                assert n < 4 or any(known[k] & set(zip(*map(np.ndarray.tolist, D.seeds(g, k)))) for k in used), (n, places)


@pytest.mark.parametrize("most", [D.MOST_SEEDS, 0])
def test_short_items_with_a_substitution(spark, most):
    items = [passage(n, 20 + n) for n in range(5, 16)]
    texts = [" ".join(["x"] * 9 + w[: len(w) // 2] + ["zzz"] + w[len(w) // 2 + 1 :] + ["y"] * 9) for w in items]
    got = contaminated(spark, texts, [" ".join(w) for w in items], most_seeds=most)
    assert got == {k: (True, [k], len(w)) for k, w in enumerate(items)}


def test_decontamination_at_exactly_the_most_seeds(spark):
    p = " ".join(passage())
    bench = spark.createDataFrame([(0, p)], "item_id long, text string")
    n = D.item_seeds(bench.withColumn("key", F.lit(1).cast("long"))).count()
    assert contaminated(spark, [p], [p], most_seeds=n)[0] == (True, [0], 30)


def test_decontamination_of_nothing(spark):
    assert contaminated(spark, ["a b c"], [])[0] == (False, [], 0)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.contamination(spark, docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_masks_tolerate_what_they_ignore():
    h = np.arange(1, 40, dtype=np.uint64)
    g = h.copy()
    g[[k for k, c in enumerate(D.MASKS[1]) if c == "0"]] = 999
    assert D.seeds(h, 1)[1][0] == D.seeds(g, 1)[1][0] and D.seeds(h, 0)[1][0] != D.seeds(g, 0)[1][0]


# --- LM scoring


def brute_scores(train, docs, leave_out=False):
    toks = lambda t: (t or "").encode().lower().split()
    two, one, uni = Counter(), Counter(), Counter()
    for t in train:
        w = toks(t)
        for v, x in zip([None, *w], w):
            two[v, x] += 1
            one[v] += 1
            uni[x] += 1
    n = sum(uni.values())
    out = []
    for t in docs:
        w, s = toks(t), 0.0
        pairs = list(zip([None, *w], w)) if leave_out else []
        own_two, own_one = Counter(pairs), Counter(v for v, _ in pairs)
        for v, x in zip([None, *w], w):
            c2, c1 = two[v, x] - own_two[v, x], one[v] - own_one[v]
            s += math.log(c2 / c1) if c2 else math.log(M.ALPHA * uni[x] / n) if uni[x] else math.log(M.ALPHA / (n + 1))
        out.append((len(w), s))
    return out


def lm_corpus():
    rnd = random.Random(4)
    words = ["the", "The", "of", "ä", "x,"] * 10 + [f"w{k}" for k in range(80)]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    return [*docs, docs[3], None, "", " \t\x0b", "the of " * 300, "only here " * 200]


@pytest.mark.parametrize("bucket", [M.BUCKET, 60])
def test_scores_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "SLICE", 500)
    docs = lm_corpus()
    rows = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(docs)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in M.score(spark, rows, bucket=bucket).collect()}
    for k, (n, s) in enumerate(brute_scores(docs, docs, leave_out=True)):
        assert got[k].n_tokens == n and got[k].log_score == pytest.approx(s, abs=1e-6), k
        assert (got[k].mean_log_score is None) == (n == 0)


def test_backoff_on_other_texts(spark):
    train, docs = lm_corpus(), ["the w1 never seen", "of the of", "w3 w4 w5 w6 x, x, x,"]
    a = spark.createDataFrame([(t,) for t in train], "text string")
    b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for bucket in (M.BUCKET, 60):
        got = {r.doc_id: r for r in M.score(spark, b, a, bucket=bucket).collect()}
        for k, (n, s) in enumerate(brute_scores(train, docs)):
            assert got[k].n_tokens == n and got[k].log_score == pytest.approx(s, abs=1e-6), k


@pytest.mark.parametrize("codes", [0, 3, 65_535])
def test_words_with_and_without_codes(spark, monkeypatch, codes):
    monkeypatch.setattr(M, "CODES", codes)
    monkeypatch.setattr(M, "SLICE", 500)
    docs = lm_corpus()
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in M.score(spark, rows, bucket=60).collect()}
    for k, (n, s) in enumerate(brute_scores(docs, docs, leave_out=True)):
        assert got[k].n_tokens == n and got[k].log_score == pytest.approx(s, abs=1e-6), k


def test_pairs_of_hot_words_only():
    """A bigram is counted beforehand only if both its words are hot; the count of rows stays that of hot words."""
    x = pd.DataFrame({"doc_id": range(200), "text": [f"the w{k} the of rare{k} the" for k in range(200)]})
    the, of = M.token_hashes("the of")
    got = pd.concat(M.tallied_pairs(iter([x]), np.array([the]), np.array([the, of])))
    assert [(M.unsigned(v), M.unsigned(w), n) for v, w, n in got.itertuples(index=False)] == [(the, of, 200)]


def test_packed_bytes_a_token():
    """Words of a large share travel in two bytes, and counts in as few as they need."""
    rnd = random.Random(2)
    word = [f"w{k}" for k in range(3000)]
    x = pd.DataFrame({"doc_id": range(300), "text": [" ".join(rnd.choices(word, [1 / (k + 1) for k in range(3000)], k=400)) for _ in range(300)]})
    words = {int(w): c for w, c in zip(*np.unique(np.concatenate([M.token_hashes(t) for t in x["text"]]), return_counts=True))}
    often = {w: c for w, c in words.items() if c > 100}
    sent = pd.concat(M.pack(iter([x]), 4, M.Hot({}, {}, often, 120_000), True, True))
    size = sum(len(b) for c in sent.columns for b in sent[c] if isinstance(b, bytes))
    assert size < (4 + 8 * (1 - sum(often.values()) / 120_000) + 1) * 120_000  # 12 bytes a token when every word was a hash


@pytest.mark.parametrize("buckets", [1, 7, 6000, 1 << 30])
def test_order_by_bucket_and_context(buckets):
    """One sort of one number gives the order of a sort by bucket, context and place."""
    rnd = np.random.default_rng(buckets)
    v = rnd.choice(rnd.integers(0, 1 << 64, 400, dtype=np.uint64), 5000)
    at = (M.mix(v) % np.uint64(buckets)).astype(np.int32)
    assert M.by_bucket(at, v, buckets).tolist() == np.lexsort((v, at)).tolist()
    assert len(M.by_bucket(at[:0], v[:0], buckets)) == 0


def test_tallies_of_contexts_and_words():
    texts = ["a b a", None, "b", "", "a a c b", " "]
    got = {M.unsigned(v): (n, c) for v, n, c in pd.concat(M.tallied(iter([pd.DataFrame({"text": texts})]))).itertuples(index=False)}
    a, b, c = M.token_hashes("a b c")
    assert got == {a: (3, 4), b: (2 - 1, 3), c: (1, 1), M.BEGIN: (3, 0)}


def test_lm_edges(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in M.score(spark, rows).collect()}
    assert got == {1: 4, None: 1, 2: 0}
    assert M.score(spark, rows.limit(0)).count() == 0


# --- language


def test_language_id(spark):
    en, de = "the cat and the dog went over the hill with their things", "der hund und die katze gehen über den berg mit ihren sachen"
    rows = [(k, (en if k % 2 else de) + f" {k}", "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "1234 ... !!", "en"), (103, "the hill " * 200_000, None), (None, de, None), (1, en, "en")]
    got = G.identify(spark, spark.createDataFrame(rows, DOC), prefix="p_").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.p_lang_pred, r.p_score) == ("und", 0.0)
        else:
            assert r.p_lang_pred == ("en" if "the" in r.text else "de") and 0 < r.p_score <= 1
        if r.doc_id is not None:
            import zlib

            assert r.p_held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_id_does_not_read_labels_of_held_out_rows(spark):
    import zlib

    rows = [(k, "the cat and the dog", "en" if zlib.crc32(str(k).encode()) % 4 != 2 else "xx") for k in range(40)]
    assert {r.lang_pred for r in G.identify(spark, spark.createDataFrame(rows, DOC)).collect()} == {"en"}


def test_language_id_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], DOC)
    assert G.identify(spark, df).first().lang_pred == "und"
    assert G.identify(spark, df.limit(0)).count() == 0


def test_grams_in_pieces_equal_those_of_the_whole(monkeypatch):
    text = "über den Berg gehen wir mit 12 Sachen! " * 40
    whole = G.grams(text)
    monkeypatch.setattr(G, "PIECE", 37)
    parts = G.grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# --- quality


def test_quality(spark):
    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)) + "."
    bad = lambda: " ".join(rnd.choice("ALPHA BETA GAMMA".split()) + "!!" for _ in range(30))
    rows = [(k, good() if k % 3 else bad()) for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x"), (1, "again alpha")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(5, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.score(spark, docs, labels, prefix="q_").collect()
    assert len(got) == 404 and all(0 <= r.q_score <= 1 and r.q_predicted == int(r.q_score >= 0.3) for r in got)
    held = [r for r in got if r.q_held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.q_predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    assert len({r.q_score for r in got if r.doc_id in (1000, 1001)}) == 1


def test_quality_with_one_class_or_none(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(20)], "doc_id long, text string")
    ones = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r.predicted for r in Q.score(spark, docs, ones).collect()} == {1}
    assert {r.score for r in Q.score(spark, docs, ones.limit(0)).collect()} == {0.5}
    assert Q.score(spark, docs.limit(0), ones).count() == 0


def test_index_vectors_are_sparse_and_fixed():
    v = Q.index_vector("word")
    assert (v != 0).sum() == 8 and np.isclose((v * v).sum(), 1) and (v == Q.index_vector("word")).all()
    assert hashlib.md5(Q.index_vector("x").tobytes()).digest() != hashlib.md5(v.tobytes()).digest()
