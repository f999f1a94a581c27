import hashlib
import random

import pytest
import sentencepiece as lib

import corpus_pipeline as P
from noveltide.llm import decontam, queries, sentencepiece, simhash

from .test_line_dedup import brute

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = text.lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_pipeline_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [decontam.words(r[0]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    docs = [(d, t) for d, t in docs if t is not None and any(c.isalpha() for c in t)]
    texts = brute(docs)
    sets = {d: shingles(texts[d]) for d, _ in docs}
    group = {d: d for d, _ in docs}
    for a in group:
        for b in list(group)[: list(group).index(a)]:
            k = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (k and k >= 0.8 * (len(sets[a]) + len(sets[b]) - k)):
                low, high = sorted((group[a], group[b]))
                group.update({d: low for d in group if group[d] == high})
    kept = [d for d in group if group[d] == d]

    def leaked(words):
        for w in items:
            need = min(decontam.LEAST, len(w))
            for at in range(-len(w), len(words)):
                same = sum(0 <= at + k < len(words) and words[at + k] == x for k, x in enumerate(w))
                if same >= max(need, 0.8 * len(w)):
                    return True
        return False

    kept = [d for d in kept if not leaked(decontam.words(texts[d]))]
    model = lib.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == sorted(kept)
    for d in kept:
        ids = model.encode(texts[d])
        assert got[d].n_tokens == len(ids) and got[d].round_trip and got[d].n_chars == len(texts[d])
        assert got[d].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_edge_rows(spark, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat sat on the mat by the door of the house", "en", "s", 47)] * 2 + [(2, None, None, None, None), (3, "", "en", "s", 0), (None, "der hund und die katze", "de", None, None), (4, "12 34", "en", "s", 5)]
    df = spark.createDataFrame(rows, kind)
    out = stage(spark, df, SF)
    assert out.count() <= len(rows)
    if stage is not P.STAGES[-1][1]:
        assert out.columns == df.columns
    assert stage(spark, df.limit(0), SF).count() == 0


def test_one_row_of_each_component_survives(spark):
    texts = ["the cat sat on the mat by the door of the house", "a wholly different text on ships that sail over the northern sea", "prices of grain rose again as the harvest failed in the east"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, "again some other words that have nothing to do with it"), (8, texts[2].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    got = [(r.doc_id, r.text) for r in P.simhash_dedup(spark, df, SF).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)


def test_near_copies_of_similarity_over_the_threshold(spark):
    """Nine in ten pairs just over the threshold are found, and none below it."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows, close = [], {}
    for k in range(200):
        x = [rnd.choice(vocabulary) for _ in range(rnd.choice((30, 120, 400)))]
        y = list(x)
        share = rnd.choice((0.8, 0.6))
        while True:
            z = list(y)
            z[rnd.randrange(len(z))] = rnd.choice(vocabulary)
            s, t = shingles(" ".join(x)), shingles(" ".join(z))
            y = z if len(s & t) >= share * len(s | t) or share < 0.8 else y
            if len(s & t) < share * len(s | t):
                break
        close[k] = len(shingles(" ".join(x)) & shingles(" ".join(y))) >= 0.8 * len(shingles(" ".join(x)) | shingles(" ".join(y)))
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(y))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_rows(spark, df).collect()}
    found = {k: got[2 * k + 1] == 2 * k for k in close}
    assert not any(found[k] for k in close if not close[k]) and all(got[2 * k] == 2 * k for k in close)
    assert sum(found[k] for k in close if close[k]) >= 0.9 * sum(close.values())


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefghik") for _ in range(6)) for _ in range(200)]
    rows = []
    for d in range(300):
        x = list(base)
        x[rnd.randrange(200)] = f"other{d}"
        rows.append((d, " ".join(x), "en", "s", 0))
    df = spark.createDataFrame(rows + [(400 + k, None, None, None, None) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, df, SF).collect()) == [0, 400]


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.queries()) < set(names) and [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10
    assert names["pipeline"] is P.run and P.ORACLE_SQL is None and "op6_lm_score" in entry.oracle_sql()


def test_workers_give_memory_back(spark, tmp_path, monkeypatch):
    """Idle workers stay beside the next stage; the stages that fill them return what their allocators keep."""
    import uuid

    from noveltide.llm import common, langid, sentencepiece

    common.give_back()
    for module, run in ((langid, lambda d: langid.identify(spark, d)), (sentencepiece, sentencepiece.round_trip)):
        seen = tmp_path / module.__name__
        seen.mkdir()

        def told(at=str(seen)):
            open(f"{at}/{uuid.uuid4().hex}", "w").close()

        monkeypatch.setattr(module, "give_back", told)
        docs = spark.createDataFrame([(k, f"the cat and the dog {k}", "en") for k in range(20)], "doc_id long, text string, lang string")
        assert run(docs).count() == 20 and len(run(docs).collect()) == 20
        assert list(seen.iterdir())
