"""Edge cases of prompts, judges, containment, schedules, reports and idea symbols."""

from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions import text as T
from noveltide.operators import corpus, cost, ideas, records, training
from noveltide.session import materialize


def test_train_prompt_precedence(spark):
    kind = "id int, refined_statement string, prompt string, input string, messages array<struct<role:string,content:string>>"
    rows = [
        (1, "a = a", "p", "i", []),
        (2, None, "  p ", "i", []),
        (3, "", " ", " i\n", []),
        (4, None, None, None, [("assistant", "no"), ("user", None), ("user", " yes "), ("user", "later")]),
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r.t for r in df.select("id", records.train_prompt(df).alias("t")).collect()}
    assert got == {1: "Prove or rigorously justify the following.\n\na = a", 2: "p", 3: "i", 4: "yes", 5: None}


def test_judge_answers(spark):
    texts = ['so: {"a": 1, "b": "2.5"} done', '{"a": 1}', '{"a": 1, "b": "x"}', "none", None, '{"a": 1, "b": }']
    got = [r.j for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.parse_judge(F.col("t"), ["a", "b"]).alias("j")).orderBy("k").collect()]
    assert got[0] == (1.0, 2.5) and got[1:] == [None] * 5


def test_split_and_strip(spark):
    texts = ["A b. C! ;; D—e ? f　", "  ", "", None, ";;", "one \ttwo\n\nthree", ". ; .", "x.y. z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [tuple(r) for r in df.select("k", T.split_ideas(F.col("t")).alias("s"), T.normalize_text(F.col("t")).alias("n")).orderBy("k").select("s", "n").collect()]
    assert [g[0] for g in got] == [["A b.", "C!", "D", "e ?", "f"], [], [], [], [";;"], ["one \ttwo\n\nthree"], [".", "."], ["x.y.", "z"]]
    assert got[5][1] == "one two three" and got[3][1] == ""


def test_containment_and_schedule(spark):
    out = spark.createDataFrame([(1, ["b", "c"]), (2, ["c", "b"]), (3, []), (4, ["a", "b", "c", "d", "e"]), (5, ["b"])], "k int, s array<string>")
    seen = spark.createDataFrame([(["a", "b", "c", "d"],), (["b"],), ([],)], "s array<string>")
    assert {r.k: r.contained for r in training.contained(out, seen, "k", "s").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "t int, i string")
    assert training.follows_schedule(a, a, "t", "i").first().follows
    assert not training.follows_schedule(a, a.distinct(), "t", "i").first().follows
    assert training.follows_schedule(a.limit(0), a.limit(0), "t", "i").first().follows


def test_dominance_and_baselines(spark):
    e = spark.createDataFrame([(1, "S1", 0.1, 0.05), (1, "S2", 0.3, 0.0), (2, "S1", 0.1, 0.1), (2, "S2", 0.3, 0.0), (3, "S2", 9.0, 0.0)], "k int, top string, g double, e double")
    assert {r.k: r.dominates for r in training.dominates(e, "k", "top", "g", "e", "S2", "S1").collect()} == {1: True, 2: False}
    r = spark.range(1).select(M.utility_only(F.lit(0.4), 0.5).alias("a"), M.novelty_only(F.lit(None).cast("double")).alias("b"), M.shifted_score(F.lit(0.5), 0.5, F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.0, 0.0, 0.0)


def test_report_falls_back_to_the_judge(spark):
    costs = spark.createDataFrame([("x", 10, None), ("y", 10, 2.0)], "domain string, prompts long, gen_usd double")
    judges = spark.createDataFrame([("x", 1.5)], "domain string, judge_usd double")
    full = spark.createDataFrame([("x", 100)], "domain string, full_rows long")
    got = {r.domain: (r.gen_usd, r.judge_usd, r.total_usd, r.full_usd) for r in cost.report(costs, judges, full).collect()}
    assert got == {"x": (None, 1.5, 1.5, 15.0), "y": (2.0, 0.0, 2.0, 2.0)}


def test_keep_first_keeps_other_texts_of_one_order(spark):
    rows = [(1, "A  b"), (1, "a b"), (1, "c"), (None, "d"), (None, "e"), (2, "a b")]
    got = corpus.dedup_keep_first(spark.createDataFrame(rows, "id int, text string"), ["id"]).collect()
    assert sorted((r.id or 0, r.text) for r in got) == [(0, "d"), (0, "e"), (1, "A  b"), (1, "c")]


def test_net_wins(spark):
    rows = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 3.0), ("a", 4, None), ("b", 5, 1.0)]
    got = {r.k: r.net for r in training.net_wins(spark.createDataFrame(rows, "g string, k int, r double"), "g", "r", 0.5).collect()}
    assert got == {1: -1, 2: -1, 3: 2, 4: 0, 5: 0}


def test_idea_symbols_and_materialize(spark):
    texts = spark.createDataFrame([(1, "alpha beta. alpha beta! gamma"), (2, ""), (3, None)], "id int, text string")
    first = ideas.dense(ideas.hash_encode(spark.createDataFrame([(7, "alpha beta"), (8, "gamma")], "cid int, t string"), ["cid"], "t"), ["cid"], 64)
    got = materialize(ideas.idea_symbols(texts, "id", "text", first.withColumnRenamed("embedding", "centroid")), "test")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "c7"), (1, 1, "c7"), (1, 2, "c8")]


def test_model_files_closure_and_registries(spark, tmp_path):
    import pytest

    from noveltide.operators import lm
    from noveltide.plans import creativity as C

    syms = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "doc_id int, pos int, sym string")
    m = C.train(syms)
    m.save(str(tmp_path))
    back = C.Model.load(spark, str(tmp_path))
    assert sorted(map(tuple, back.p.collect())) == sorted(map(tuple, m.p.collect()))
    cut = m.p.where("not (n = 2 and ctx = 'a' and w = 'b')")
    entries = {(r.n, r.gram): r.log10p for r in lm.arpa_entries(cut, m.b).collect()}
    assert entries[2, "a b"] == -99.0 and all(g.rsplit(" ", 1)[0] in {x for k, x in entries if k == n - 1} for n, g in entries if n > 1)
    with pytest.raises(ValueError, match="not registered"):
        C.receiver_expansion(syms, syms, syms, 2, "doc_id", receiver="none")
