"""Published and derived values, and the edge inputs of each operator."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions import text as T
from noveltide.operators import corpus, cost, ideas, information, lm, records, scores, training, trajectory
from noveltide.plans import creativity
from noveltide.sources import readers, sinks
from noveltide.streaming import trajectories as streams


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_gates_are_strict(spark):
    r = one(spark, *[M.cue_gate(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.1, 0.0, -1.0))], *[M.novelty_gate(F.lit(a), b).alias(f"d{i}") for i, (a, b) in enumerate(((1.0, 0.0), (0.0, 0.0), (0.5, 0.4)))])
    assert list(r) == [1, 0, 0, 1, 0, 1]


def test_brier_and_cue(spark):
    prior, post = F.array(*[F.lit(0.25)] * 4), F.array(*map(F.lit, (0.7, 0.1, 0.1, 0.1)))
    d = M.brier_delta(prior, post, F.lit(0))
    r = one(spark, M.brier(prior, F.lit(0)), M.brier(post, F.lit(0)), M.cue(d, T.bit_length_utf8(F.lit("0123456789"))), M.cue(F.lit(0.63), F.lit(0.0)))
    assert r[0] == pytest.approx(0.75) and r[1] == pytest.approx(0.12) and r[2] == pytest.approx(0.007875) and r[3] == pytest.approx(0.63 / 8)


def test_closed_gate_gives_zero_and_score_grows_with_cue(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 0.5, 0.2), (0.1, 0.0, 0.5, 0.2), (0.1, 1.0, 0.5, 0.2), (0.2, 1.0, 0.5, 0.2)], "cue double, r_d double, r_b double, g_k double")
    got = [r.score for r in scores.with_score(rows, lambda_g=1.0).collect()]
    assert got[:2] == [0, 0] and got[2] == pytest.approx(0.1 * 1.5 + 0.2) and got[3] > got[2]


def test_effective_lambda(spark):
    r = one(spark, *[M.effective_lambda(F.lit(t), g, 1.0).alias(str(i)) for i, (t, g) in enumerate(((False, 0.5), (True, 0.5), (True, 0.0)))])
    assert list(r) == [0, 0.5, 1.0]


EDGES = [None, "", "   ", "a b", " x ", "a\x0bb\x1cc", "no end", "...", "One. Two. Three.", "a; b — c", "İstanbul ß É", ";;", "Q? A! End"]


def python_split(text):
    import re

    text = (text or "").strip()
    if not text:
        return []
    out = [c.strip() for p in re.split(r"(?<=[.!?])\s+", text) for c in re.split(r"\s*[;—]\s*", p.strip())]
    return [c for c in out if c] or [text]


def test_text_edges_match_python(spark):
    import re

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = {r.i: r for r in rows.select("i", T.normalize_text(F.col("t")).alias("n"), T.split_ideas(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(EDGES):
        assert got[i].n == re.sub(r"\s+", " ", (t or "").strip().lower()), repr(t)
        assert got[i].s == python_split(t), repr(t)


def test_beliefs_and_outcomes(spark):
    labels = scores.LABELS
    texts = ['{"novel_structure": 3, "clear utility": 1}', "nothing", "{bad", '{"low_quality": "x"}', '{"novel_structure": -1, "low_quality": 3}', 'so {"novel_structure": 1} done']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [list(r.p) for r in rows.orderBy("i").select(T.parse_beliefs(F.col("t"), labels).alias("p")).collect()]
    assert got[0] == [0.75, 0, 0.25, 0] and got[1] == got[2] == got[3] == [0.25] * 4 and got[4] == [-0.5, 0, 0, 1.5] and got[5] == [1, 0, 0, 0]
    outs = ['{"label": "clear_utility"}', "I say fluent_paraphrase", "?", '{"label": "other"} novel_structure', None]
    rows = spark.createDataFrame(list(enumerate(outs)), "i int, t string")
    assert [r.o for r in rows.orderBy("i").select(T.classify_outcome(F.col("t"), labels).alias("o")).collect()] == [2, 1, 3, 0, 3]


@pytest.mark.parametrize(
    ("text", "approved"),
    [
        ('{"verdict": "APPROVE", "task_valid": true, "addresses_critique": true}', True),
        ('{"verdict": " approve ", "task_valid": true, "addresses_critique": true}', True),
        ('{"verdict": "REJECT", "task_valid": true, "addresses_critique": true}', False),
        ('{"verdict": "NOT APPROVED", "task_valid": true, "addresses_critique": true}', False),
        ('{"verdict": "APPROVE", "task_valid": true, "addresses_critique": false}', False),
        ('{"verdict": "APPROVE", "task_valid": false, "addresses_critique": true}', False),
        ('{"verdict": "APPROVE", "task_valid": "true", "addresses_critique": true}', False),
        ("", False), ("approve", False), ('{"verdict": "APPROVE"}', False), (None, False),
    ],
)
def test_verdicts(spark, text, approved):
    assert spark.createDataFrame([(text,)], "t string").select(T.parse_verdict(F.col("t"))["approved"]).first()[0] is approved


def test_feedback(spark):
    v = T.parse_verdict(F.lit('{"verdict": "REJECT", "unresolved_issues": ["a", "b"], "reason": "r"}'))
    w = T.parse_verdict(F.lit('{"verdict": "REJECT", "reason": " r "}'))
    assert list(one(spark, T.verifier_feedback(v), T.verifier_feedback(w))) == ["a; b", "r"]


def test_accounting(spark):
    bank = spark.createDataFrame([("Probe zero",)], "text string")
    raw = spark.createDataFrame([(1, "probe  ZERO"), (2, "a"), (3, "A "), (4, "b")], "id int, text string")
    banned = corpus.banned_hashes(bank)
    assert list(corpus.exclusion_accounting(raw, banned).first()) == [4, 2, 1, 1]
    assert [r.id for r in corpus.dedup_keep_first(corpus.decontaminate(raw, banned), ["id"]).orderBy("id").collect()] == [2, 4]
    with pytest.raises(ValueError, match="frozen"):
        corpus.assert_no_overlap(raw, banned)
    bad = spark.createDataFrame([(10, 5, 3, 1)], "n_raw long, n_kept long, n_contaminated long, n_duplicate long")
    with pytest.raises(Exception, match="raw is not"):
        corpus.check_accounting(bad).collect()
    with pytest.raises(ValueError):
        corpus.require_rows(raw)
    assert list(corpus.exclusion_accounting(raw.limit(0), banned).first()) == [0, 0, 0, 0]


def toy(spark):
    rows = [(k, p, f"i{s}") for k, seq in ((1, (0, 1, 2)), (2, (1, 2, 0))) for p, s in enumerate(seq)]
    return spark.createDataFrame(rows, "doc_id int, pos int, sym string")


def seqs(spark, *xs):
    return spark.createDataFrame([(k, p, f"i{s}") for k, seq in enumerate(xs) for p, s in enumerate(seq)], "doc_id int, pos int, sym string")


def test_toy_model(spark):
    m = creativity.train(toy(spark))
    p = {(r.n, r.ctx, r.w): r.p for r in m.p.collect()}
    want = {(1, "", "i0"): 0.25, (1, "", "</s>"): 0.25, (2, "<s>", "<s>"): 0.285714, (2, "<s>", "i0"): 0.142857, (2, "i1", "i2"): 0.666667, (2, "i2", "</s>"): 0.25,
            (3, "<s> <s>", "i0"): 0.25, (3, "<s> i0", "i1"): 0.5, (3, "i1 i2", "i0"): 0.25, (3, "i2 i0", "</s>"): 0.5}
    for k, v in want.items():
        assert p[k] == pytest.approx(v, abs=1e-6), k
    b = {(r.n, r.ctx): r.bow for r in m.b.collect()}
    for k, v in {(1, "<s>"): 0.857143, (1, "i0"): 1, (1, "i1"): 1.333333, (1, "i2"): 1, (2, "<s> <s>"): 1.75, (2, "<s> i0"): 2, (2, "<s> i1"): 0.75, (2, "i0 i1"): 0.75, (2, "i1 i2"): 1, (2, "i2 i0"): 2}.items():
        assert b[k] == pytest.approx(v, abs=1e-6), k
    bits = {r.doc_id: r.bits for r in lm.sequence_bits(seqs(spark, (0, 1, 2), (2, 1, 0), (9,)), m.p, m.b).collect()}
    assert bits[0] == pytest.approx(6.807355, abs=1e-6) and bits[1] == pytest.approx(7.807355, abs=1e-6)
    assert bits[2] > 328.87


def test_novelty_by_tail_equals_the_literal_sum(spark):
    m = creativity.train(toy(spark))
    probes = seqs(spark, (0, 1, 2), (2,), (1, 1)).withColumnRenamed("doc_id", "item_id")
    ys = [(1, 2, 0), (1,), (2, 2), (0, 1), (9, 9), (0, 0, 1)]
    got = {r.doc_id: r.r_d for r in lm.structural_novelty(lm.tails(seqs(spark, *ys)), probes, m.p, m.b).collect()}
    p = {(r.n, r.ctx, r.w): r.p for r in m.p.collect()}
    bow = {(r.n, r.ctx): r.bow for r in m.b.collect()}

    def cost_(w, c1, c2):
        x = f"{c2} {c1}"
        if (3, x, w) in p:
            return -math.log2(p[3, x, w])
        low = p.get((2, c1, w))
        low = bow.get((1, c1), 1.0) * p.get((1, "", w), 1e-99) if low is None else low
        return -math.log2(bow.get((2, x), 1.0) * low)

    def run(state, seq):
        total = 0
        for w in [*seq, "</s>"]:
            total += cost_(w, state[-1], state[-2])
            state = [*state, w]
        return total

    ps = [[f"i{s}" for s in q] for q in ((0, 1, 2), (2,), (1, 1))]
    for k, y in enumerate(ys):
        want = sum(run(["", "<s>"], q) - run(["", "<s>", *[f"i{s}" for s in y]], q) for q in ps)
        assert got[k] == pytest.approx(want, abs=1e-9), y


def test_normalized_backoff_adds_up(spark):
    c = lm.counts(toy(spark))
    p = lm.probabilities(c)
    b = {(r.n, r.ctx): r.bow for r in lm.backoffs(c, p, normalized=True).collect()}
    pp = {(r.n, r.ctx, r.w): r.p for r in p.collect()}
    vocab = ["i0", "i1", "i2", "</s>"]
    total = sum(pp.get((2, "i0", w), b[1, "i0"] * pp[1, "", w]) for w in vocab)
    assert total == pytest.approx(1, abs=1e-9)


def test_report_on_three_rows_and_on_none(spark):
    rows = spark.createDataFrame([(s, 1.0, 1.0, 0.5, None, 1.0, 1.0, d) for s, d in ((1.0, "a"), (2.0, ""), (3.0, None))], "score double, cue double, r_d double, r_b double, g_k double, cue_gate double, d_gate double, domain string")
    r = scores.report(rows).first()
    assert (r.n, r.mean_score, r.std_score) == (3, 2, 1) and r.ci95_high - 2 == pytest.approx(1.131607, abs=1e-6) and r.mean_g_k == 0
    assert [(x.domain, x.n) for x in scores.report_by_domain(rows).collect()] == [("a", 1)]
    single = scores.report(rows.limit(1)).first()
    assert single.std_score == 0 and single.ci95_low == single.ci95_high == single.mean_score
    assert math.isnan(scores.report(rows.limit(0)).first().ci95_low)


def test_calibration(spark):
    rows = spark.createDataFrame([("paraphrase", x) for x in (3.0, 1.0, 2.0)] + [("restructure", 2.5)], "kind string, r_d double")
    r = scores.calibrate_delta(rows).first()
    assert not r.separable and r.delta_d == pytest.approx(2.001)
    rows = spark.createDataFrame([("paraphrase", 1.0), ("restructure", 2.0)], "kind string, r_d double")
    assert scores.calibrate_delta(rows).first().delta_d == 1.5


def points(spark, *series):
    return spark.createDataFrame([(k, t + 1, float(v)) for k, s in enumerate(series) for t, v in enumerate(s)], "k int, t int, v double")


def test_diverge_converge(spark):
    got = {r.k: (r.dc, r.peak_index) for r in trajectory.diverge_converge(points(spark, (-1, 0, -1), (0, 1, 2, 1, 0), (1, 2, 3), (3, 2, 1), (1, 1, 1), (1, 2), (0, 1, 1, 0), (0, 2, 1, 2, 0)), "k").collect()}
    assert got == {0: (1, 1), 1: (1, 2), 2: (0, None), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None), 7: (0, None)}


def test_curve_fit(spark):
    t = np.arange(1, 8)
    y = 1 * (1 - np.exp(-0.5 * t)) + 0.1 * t
    got = {r.k: r for r in trajectory.step_cue_fit(points(spark, y, (0.9, 0.99, 0.999, 0.9999, 0.99999), (1, 2), (1, 2, 2.5)), "k").collect()}
    assert abs(got[0].c_inf - 1) < 0.05 and abs(got[0].mu - 0.5) < 0.05 and abs(got[0].gamma - 0.1) < 0.05 and got[0].residual_rmse < 1e-4 and got[0].reliable
    assert abs(got[1].gamma) < 0.05
    assert got[2].c_inf is None and not got[2].reliable and not got[3].reliable and got[3].c_inf is not None


def test_curve_fit_where_the_exponential_overflows(spark):
    """Texts of 26, 297 and 122 words drive mu so far down that exp(-mu t) is infinite."""
    series = [[math.log(n + 1) for n in (26, 297, 122)], (1.0, 2.0, math.inf), (2.0, 3.0, 3.5, 3.6)]
    got = {r.k: r for r in trajectory.step_cue_fit(points(spark, *series), "k").collect()}
    assert got[0].n_points == 3 and all(math.isfinite(x) for x in (got[0].c_inf, got[0].mu, got[0].gamma, got[0].residual_rmse))
    assert got[1].n_points == 3 and got[1].c_inf is None and not got[1].reliable
    assert got[2].reliable and got[2].residual_rmse < 0.05


def test_step_order_and_records(spark):
    steps = [Row(role="p", step="draft", round=None, content="d"), Row(role="v", step="verify", round=1, content="x"), Row(role="p", step="revision", round=2, content="r2"), Row(role="p", step="revision", round=1, content="r1"), Row(role="p", step="draft", round=None, content="again")]
    df = spark.createDataFrame([(1, steps)], "id int, transcript array<struct<role:string,step:string,round:int,content:string>>")
    got = records.trajectory_steps(records.explode_transcript(df, "id"), "id").orderBy("t").collect()
    assert [r.content for r in got] == ["d", "r1", "r2"]
    df = spark.createDataFrame([(1, [{"response-1": "a"}], None, None), (2, [{"x": "b"}], None, None), (3, [], "j", None), (4, None, "", "r"), (5, [{"response-1": None}], "j", "r")], "id int, responses array<map<string,string>>, joint_text string, response string")
    assert [r[0] for r in df.orderBy("id").select(records.response_text(df, "response-1")).collect()] == ["a", "b", "j", "r", None]


def test_prompts_of_both_paths(spark):
    df = spark.createDataFrame([(("o", "", "s"), None)], "research_idea struct<objective:string,problem_statement:string,solution_approach:string>, prompt string")
    assert df.select(records.cost_prompt(df)).first()[0] == "Objective: o\n\nSolution approach: s" and df.select(records.eval_prompt(df)).first()[0] == "o\n\ns"
    df = spark.createDataFrame([("", "f")], "refined_statement string, formal_statement string")
    assert df.select(records.eval_prompt(df)).first()[0].endswith(".\n\nf")
    with pytest.raises(Exception, match="no prompt"):
        df.select(records.cost_prompt(df)).collect()


def test_length_gain(spark):
    rows = spark.createDataFrame([(1, "a", "one two three"), (1, "a", "x y z"), (1, "j", " ".join("w" * 14)), (2, "j", "x")], "id int, role string, text string")
    got = {r.id: r.g_k for r in records.length_gain(rows, "id", F.col("role") == "a", F.col("role") == "j").collect()}
    assert got[1] == pytest.approx(math.log(15) - math.log(4)) and got[2] == 0


def test_golden_costs(spark):
    d = spark.createDataFrame([("infinity_chat", 10, 307), ("formalmath", 10, 756), ("rinobench", 10, 2866)], "domain string, prompts long, input_tokens long")
    g = cost.generation_cost(d, cost.catalog(spark))
    by = {(r.domain, r.model_id): r.gen_usd for r in g.collect()}
    assert by["infinity_chat", "openai/gpt-4o-mini"] == pytest.approx(0.02404605, abs=1e-12)
    scale = F.when(F.col("domain") == "rinobench", 29.9).otherwise(30.0)
    r = cost.project(g, scale).first()
    assert r.sample_usd == pytest.approx(13.923652018, abs=1e-9) and r.full_usd == pytest.approx(417.2418527028, abs=1e-8)
    roll = {x.family: x for x in cost.rollup(g).collect()}
    assert round(roll["claude"].gen_usd, 4) == 10.2668 and roll["claude"].gen_calls == 450 and round(roll["glm"].gen_usd, 4) == 0.3681
    assert "| openrouter | claude | $10.2668 | 450 |" in cost.markdown(cost.rollup(g))


def test_availability_and_quota(spark):
    m = spark.createDataFrame([("qwen3:1b",), ("a",), ("b:2",)], "model_id string")
    names = spark.createDataFrame([("qwen3",), ("a",)], "name string")
    assert {r.model_id: r.available for r in cost.available(m, names).collect()} == {"qwen3:1b": True, "a": True, "b:2": False}
    assert list(one(spark, *[cost.quota_tier(F.lit(x)) for x in (50, 500, 501)])) == ["free", "pro", "max"]


def test_advantages(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 3.0), (2, 2, 3.0), (3, 1, 9.0)], "g int, k int, r double")
    got = {r.g: (r.a1, r.a2) for r in training.two_rollout_advantage(rows, "g", "k", "r").collect()}
    assert got[1][0] == pytest.approx(2**-0.5) and got[1][1] == pytest.approx(-(2**-0.5)) and got[2] == (0, 0) and 3 not in got
    assert {r.r: r.advantage for r in training.group_advantage(rows.where("g = 1"), "g", "r").collect()}[5.0] == pytest.approx(1, abs=1e-6)


def test_pairs_are_counted_without_being_listed(spark):
    rows = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(np.random.default_rng(0).integers(0, 40, 120))], "g int, r double").withColumn("id", F.monotonically_increasing_id())
    listed = {r.g: r["count"] for r in training.valid_pairs(rows, "g", "id", "r", 2.0).groupBy("g").count().collect()}
    assert {r.g: r.n_pairs for r in training.pair_counts(rows, "g", "r", 2.0).collect()} == listed


def test_pareto_matches_definition(spark):
    v = np.random.default_rng(1).integers(0, 12, (60, 2)).tolist()
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(v)], "id int, b int, d int")
    want = {i for i, (b, d) in enumerate(v) if not any(b2 > b and d2 >= d for b2, d2 in v)}
    assert {r.id for r in training.pareto_frontier(rows, "b", "d").collect()} == want


def test_information(spark):
    rows = spark.createDataFrame([(a, b) for a in range(2) for b in range(2)] * 3, "a int, b int")
    r = information.pair_information(rows, "a", "b").first()
    assert r.mutual_info == pytest.approx(0) and r.h_ab == pytest.approx(math.log(4)) and r.gain == pytest.approx(math.log(2))
    assert information.product_kernel(rows, [("a", "b")]).first().independent
    p, q = information.pmf(rows, ["a"]), information.pmf(rows.where("a = 0"), ["a"])
    assert information.kl(q, p, ["a"]).first().kl == pytest.approx(math.log(2)) and information.kl(p, q, ["a"]).first().kl is None


def test_hash_encoder_matches_definition(spark):
    import hashlib
    import re

    texts = ["Hello world hello", "", "ß!", "a1 b2 a1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.embedding for r in ideas.dense(ideas.hash_encode(rows, ["i"], "t"), ["i"], 64).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(64)
        for tok in re.findall("[a-z0-9]+", t.lower()) or ["_empty_"]:
            for k in range(8):
                h = hashlib.sha256(f"{k}:{tok}".encode()).digest()
                v[int.from_bytes(h[:4], "little") % 64] += 1 if h[4] % 2 == 0 else -1
        assert np.allclose(got[i], v / np.linalg.norm(v)), t


def test_quantize_ties_take_the_lowest(spark):
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [0.0, 1.0])], "cid int, centroid array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.1])], "id int, embedding array<double>")
    assert ideas.quantize(v, c).first().cid == 1
    assert ideas.normalized_expansion(ideas.soft_entropy(v, ["id"], c.limit(1)), ["id"], 1).first().r_b == 0


def test_merge_spans_keeps_the_trailing_buffer(spark):
    rows = spark.createDataFrame([(1, 0, "a", [1.0], 0.2), (1, 1, "b", [3.0], 0.9), (1, 2, "c", [5.0], 0.1)], "id int, pos int, span string, embedding array<double>, p double")
    assert [(r.text, list(r.embedding)) for r in ideas.merge_spans(rows, "id").orderBy("idea").collect()] == [("a b", [2.0]), ("c", [5.0])]


def test_ngrams(spark):
    r = one(spark, ideas.ngrams(F.array(*map(F.lit, "abcd")), 3), ideas.ngrams(F.array(F.lit("a")), 3))
    assert r[0] == [["a", "b", "c"], ["b", "c", "d"]] and r[1] == []
    with pytest.raises(ValueError):
        ideas.ngrams(F.array(), 0)


def test_judges(spark):
    rows = spark.createDataFrame([(1, "j1", "novelty", 4.0), (1, "j2", "novelty", 2.0), (1, "j1", "usefulness", 1.0), (2, "j1", "novelty", 5.0), (3, "j1", "novelty", None)], "response_id int, judge string, criterion string, rating double")
    got = {r.criterion: (r.n, r["mean"]) for r in scores.judge_means(rows).collect()}
    assert got == {"novelty": (2, 4.0), "usefulness": (1, 1.0), "overall": (2, 3.5)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "domain": "d"}\n\n{bad\n{"prompt": "q"}\n{"prompt": "late"}\n')
    assert [r.prompt for r in readers.read_jsonl_head(spark, str(tmp_path / "a.jsonl"), "prompt", 4).collect()] == ["p", "q"]
    assert readers.read_many(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none")], "prompt").count() == 3
    (tmp_path / "p.json").write_text('{"seed": 42,\n "strings": ["x", "y"]}')
    assert readers.read_probes(spark, str(tmp_path / "p.json"), 42).count() == 2
    with pytest.raises(ValueError):
        readers.read_probes(spark, str(tmp_path / "p.json"), 7)
    (tmp_path / "s.json").write_text('{"domains": {"m": ["a", "b"]}}')
    assert sorted((r.domain, r.text) for r in readers.read_strings(spark, str(tmp_path / "s.json")).collect()) == [("m", "a"), ("m", "b")]
    assert readers.read_settings("[score]\nalpha = 2.0\n[lm]\nn = 4\n").alpha == 2.0
    d = readers.file_digests(spark, str(tmp_path), str(tmp_path.name))
    want = d.where("file <> 'a.jsonl'").unionByName(spark.createDataFrame([("a.jsonl", "0"), ("gone", "0")], "file string, sha256 string"))
    assert {r.file: r.problem for r in readers.verify_digests(d, want).collect()} == {"a.jsonl": "differs", "gone": "missing"}
    sinks.write_jsonl(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").first().b == "x"
    assert sinks.summary_json(spark.createDataFrame([(1, "x")], "a int, b string")) == '{"a":1,"b":"x"}'


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "t1", False), ("a", 2, "t2", True), ("a", 3, "t3", True), ("b", 1, "u1", False), ("b", 2, "u2", False), ("b", 3, "u3", False)], "key string, seq int, text string, approved boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    got = sorted((r.key, r.round, r.approved, r.done) for r in streams.run_available(streams.revise_loop(stream, 2), "loop").collect())
    assert got == [("a", 1, False, False), ("a", 2, True, True), ("b", 1, False, False), ("b", 2, False, True)]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    q = stream.writeStream.foreachBatch(sinks.append_batches(str(tmp_path / "good"), str(tmp_path / "bad"), "seq > 2")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 4 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_a_streams_rows_are_files_and_not_held_by_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "t", False), ("a", 2, "t", True)], "key string, seq int, text string, approved boolean")
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for at, df in (("full", rows), ("empty", rows.limit(0))):
        df.coalesce(1).write.parquet(str(tmp_path / at))
        out = streams.run_available(streams.revise_loop(spark.readStream.schema(rows.schema).parquet(str(tmp_path / at))), at)
        assert "MemoryPlan" not in out._jdf.queryExecution().toString() and (out.inputFiles() or at == "empty")
        assert sorted((r.round, r.done) for r in out.collect()) == ([(1, False), (2, True)] if at == "full" else [])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store


def test_vectors_and_tails_inside_rows(spark):
    texts = ["red fox. red fox; blue", "...", "One. Two! 3?", "", "a a a a. b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for dim in (64, 48):
        want = {r.id: r.embedding for r in ideas.dense(ideas.hash_encode(df, ["id"], "t", dim), ["id"], dim).collect()}
        assert {r.id: r.v for r in df.select("id", ideas.unit_vector(F.col("t"), dim).alias("v")).collect()} == want
    book = df.select(F.col("id").alias("cid"), ideas.unit_vector(F.col("t")).alias("centroid"))
    full, tail = (ideas.idea_symbols(df, "id", "t", book, tail=x) for x in (False, True))
    assert sorted(lm.tails(full, "id").collect()) == sorted(lm.tails(tail, "id").collect()) and 0 < tail.count() < full.count()
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (full, tail)):
        assert "SortMergeJoin" not in plan and "Window" not in plan  # no span is grouped or sorted
