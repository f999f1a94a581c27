import numpy as np
import pytest

from noveltide.llm import embed_dedup as E
from noveltide.llm import simhash as S
from noveltide.llm.common import Scratch, components


def closure(n, pairs):
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(lab[i], lab[j])
            changed |= lab[i] != m or lab[j] != m
            lab[i] = lab[j] = m
    return lab


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (10, 11), (11, 12), (12, 13), (13, 14), (3, 9), (2, 1)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(chain, Scratch(spark, "t")).collect()} == {0}
    assert components(chain.limit(0), Scratch(spark, "t")).count() == 0


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    monkeypatch.setattr(E, "LEAF", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(80, 16))
    v = np.concatenate([base[rng.integers(0, 80, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.0, 0.1, 0.3, 1.0], (400, 1)), rng.normal(size=(100, 16))])
    v = v * rng.uniform(0.1, 10, (500, 1))
    rows = [(k, [float(x) for x in np.float32(a)]) for k, a in enumerate(v)]
    bad = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [float("inf")] + [1.0] * 15), (505, [None] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0])]
    got = {r.vec_id: r for r in E.near_duplicates(spark, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).collect()}
    m = np.array([np.float32(a) for _, a in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    assert [got[k].n_links for k in range(500)] == hit.sum(1).tolist()
    lab = closure(500, np.argwhere(hit).tolist())
    assert [got[k].component_id for k in range(500)] == lab and [got[k].kept for k in range(500)] == [lab[k] == k for k in range(500)]
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(500, 506))
    assert got[506].component_id == got[507].component_id == 506 and got[507].n_links == 1


def test_embedding_edges(spark):
    kind = "vec_id long, embedding array<float>, key string, ok int"
    rows = [(1, [1.0, 0.0], "a", 1)] * 3 + [(None, [1.0, 0.0], None, None), (None, None, None, 2)]
    got = E.near_duplicates(spark, spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.n_links, r.component_id or -1) for r in got) == [(0, -1), (3, 1), (3, 1), (3, 1), (3, 1)]
    assert E.near_duplicates(spark, spark.createDataFrame([], kind)).count() == 0


def reference_fingerprint(text):
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two", "A b\x0bC d e", "É é the the the the", "w " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text) == reference_fingerprint(text)


def test_tree_search_finds_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 128)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near, np.arange(300, dtype=np.uint64)])).view(np.int64)
    got = {tuple(r) for r in S.links(spark, spark.createDataFrame([(int(x),) for x in fp], "fp long")).collect()}
    d = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :])
    want = {(min(int(fp[i]), int(fp[j])), max(int(fp[i]), int(fp[j]))) for i, j in np.argwhere(d <= 2) if i < j}
    assert got == want


def test_simhash_rows_and_edges(spark):
    kind = "doc_id long, text string, fp int, fingerprint string"
    t = "a quite long text about nothing in particular that is here more than once"
    rows = [(3, t, 1, "x"), (2, t.upper(), 1, None), (2, t.upper(), 1, None), (None, t, None, None), (5, None, 0, ""), (4, "", 0, ""), (None, None, None, None)]
    got = S.near_duplicates(spark, spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 2), (-1, 4), (2, 2), (2, 2), (3, 2), (4, 4), (5, 4)]
    assert {r.fingerprint for r in got if r.doc_id in (4, 5)} == {"0" * 16}
    assert S.near_duplicates(spark, spark.createDataFrame([], kind)).count() == 0
