"""More registered queries: prompts and judges, baselines and protocol checks, idea symbols, reports and closed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions import text as T
from noveltide.operators import cost, ideas, information, lm, records, scores, training
from noveltide.session import materialize
from noveltide.streaming import trajectories as streams

from . import creativity as C
from . import oracle as O
from .catalog import _CATALOG_SQL, _CENTROIDS, _TASKS, _costs, query, rounded
from .tables import table

# --- prompts, judges, predicates

_GUIDE = "(VALUES ('en', 'Write plainly.'), ('de', 'Schreibe klar.')) AS g(lang, guidance)"


@query(f"SELECT doc_id, coalesce(guidance, 'Answer as well as you can.') AS guidance FROM documents LEFT JOIN {_GUIDE} USING (lang)")
def domain_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup with a default; languages stand for domains."""
    guide = spark.createDataFrame([("en", "Write plainly."), ("de", "Schreibe klar.")], "lang string, guidance string")
    return records.with_lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", guide, "guidance", "Answer as well as you can.").select("doc_id", "guidance")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality::DOUBLE END AS novelty, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic * 0.5::DOUBLE END AS utility FROM labels""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a judge's JSON inside prose and read back; every seventh answer lacks a criterion."""
    whole = F.to_json(F.struct(F.col("quality").cast("double").alias("novelty"), (F.col("toxic") * 0.5).cast("string").alias("utility")))
    part = F.to_json(F.struct(F.col("quality").alias("novelty")))
    answer = F.concat(F.lit("Ratings:\n"), F.when(F.col("doc_id") % 7 == 0, part).otherwise(whole), F.lit("\nThat is all."))
    got = table(spark, sf_dir, "labels").select("doc_id", T.parse_judge(answer, ["novelty", "utility"]).alias("j"))
    return got.select("doc_id", "j.novelty", "j.utility")


_TURNS = """SELECT conv_id, min_by(text, turn) FILTER (role = 'user' AND text IS NOT NULL) AS first_user, min_by(text, turn) FILTER (role = 'user' AND text <> '') AS full_user FROM conversations GROUP BY conv_id"""


@query(f"""WITH t AS ({_TURNS}), s AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN '  given  ' WHEN conv_id % 5 = 1 THEN '' END AS prompt, CASE WHEN conv_id % 5 = 2 THEN 'x > 0' END AS problem FROM t),
  task AS (SELECT *, 'Prove or rigorously justify the following.' || chr(10) || chr(10) || problem AS stated FROM s)
  SELECT conv_id, coalesce(stated, nullif(trim(prompt), ''), trim(first_user, {O.WS})) AS train, coalesce(stated, nullif(prompt, ''), first_user) AS eval, coalesce(nullif(prompt, ''), full_user) AS cost FROM task""")
def prompt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three prompt extractions on records of several shapes, made from conversations."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    k = F.col("conv_id") % 5
    c = c.withColumn("prompt", F.when(k == 0, "  given  ").when(k == 1, "")).withColumn("problem", F.when(k == 2, "x > 0"))
    return c.select("conv_id", records.train_prompt(c).alias("train"), records.eval_prompt(c).alias("eval"), records.cost_prompt(c).alias("cost"))


@query("""SELECT doc_id, contains(d, 'Algebra') OR contains(d, 'Number Theory') AS math FROM (SELECT doc_id, CASE source WHEN 'src0' THEN 'Mathematics -> Algebra' WHEN 'src1' THEN 'Number Theory' ELSE 'Geometry' END AS d FROM documents) WHERE d <> ''""")
def math_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("source") == "src0", "Mathematics -> Algebra").when(F.col("source") == "src1", "Number Theory").otherwise("Geometry")
    rows = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"))
    return records.without_empty(rows, "d").select("doc_id", records.in_math_subset("d").alias("math"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL ORDER BY doc_id LIMIT 20")
def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row limit of a run, as its feature, after rows without a text are skipped."""
    return records.limit_written(records.without_empty(table(spark, sf_dir, "documents"), "text", "source"), ["doc_id"], 20).select("doc_id", "text")


# --- baselines, gates and protocol checks


@query(f"""WITH {O.SCORED}, f AS (SELECT *, CASE domain WHEN 'en' THEN 0.0005::DOUBLE ELSE 0.0001::DOUBLE END AS f FROM sc)
  SELECT doc_id, round(cue - f, 9) AS shifted_cue, round((cue - f > 0)::INT * d_gate * ((cue - f) * (1 + r_b)), 9) AS shifted_score, round(CASE WHEN cue >= f THEN cue ELSE 0 END, 9) AS utility_only,
    round(r_d, 6) AS novelty_only, round(r_b + 0.01::DOUBLE * r_d, 6) AS benchmark_reward FROM f""")
def shifted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated score, both baselines and the benchmark's reward beside it."""
    s = C.scored_documents(spark, sf_dir).withColumn("f", F.when(F.col("domain") == "en", 0.0005).otherwise(0.0001))
    c, f, r_d, r_b = (F.col(x) for x in ("cue", "f", "r_d", "r_b"))
    score = M.shifted_score(c, f, r_d, r_b, F.lit(0.0))
    return s.select("doc_id", F.round(c - f, 9).alias("shifted_cue"), F.round(score, 9).alias("shifted_score"), F.round(M.utility_only(c, f), 9).alias("utility_only"),
                    F.round(M.novelty_only(r_d), 6).alias("novelty_only"), F.round(training.benchmark_reward(r_b, r_d, 0.01), 6).alias("benchmark_reward"))


_EPISODES = "SELECT l_orderkey AS task, 'S' || l_linenumber AS topology, l_discount - l_tax AS gain, 0.01::DOUBLE AS eps, l_quantity / 50.0::DOUBLE AS milestone FROM lineitem"


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines stand for episodes: the line number for the topology."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("task"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("topology"), (F.col("l_discount") - F.col("l_tax")).alias("gain"), F.lit(0.01).alias("eps"), (F.col("l_quantity") / 50.0).alias("milestone"))


@query(f"WITH e AS (SELECT task, topology, min(gain) AS gain, any_value(eps) AS eps FROM ({_EPISODES}) GROUP BY ALL) SELECT b.task, w.gain + 2 * w.eps < b.gain AS dominates FROM e b JOIN e w ON b.task = w.task AND b.topology = 'S2' AND w.topology = 'S1'")
def topology_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.dominates(_episodes(spark, sf_dir), "task", "topology", "gain", "eps", "S2", "S1")


@query(f"SELECT task, round(gain, 6) AS gain, milestone FROM ({_EPISODES}) WHERE topology = 'S1' AND gain < 0 AND milestone < 0.7")
def groupthink_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = training.groupthink(_episodes(spark, sf_dir).where("topology = 'S1'"), "gain", "milestone")
    return e.select("task", F.round("gain", 6).alias("gain"), "milestone")


@query("SELECT o_orderkey, abs(o_totalprice - 150000) > 2 * 20000 AS resolved FROM orders")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", M.resolved(F.abs(F.col("o_totalprice") - 150000), 20000).alias("resolved"))


@query("""SELECT count(*) = 0 AS follows FROM (SELECT d, u, sum(s) AS s FROM (SELECT ts::DATE AS d, user_id AS u, 1 AS s FROM events UNION ALL SELECT ts::DATE, user_id, -1 FROM events WHERE event_type <> 'none') GROUP BY d, u HAVING sum(s) <> 0)""")
def corpus_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stand for steps, users for the items of their corpus."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("user_id").alias("u"), "event_type")
    return training.follows_schedule(e, e.where("event_type <> 'none'"), "d", "u")


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL), o AS (SELECT item_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS t FROM benchmark)
  SELECT item_id, coalesce((SELECT bool_or(contains(c.t, o.t)) FROM c), false) AS contained FROM o""")
def corpus_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts stand for policy outputs: which of them occur, word by word, in a document."""
    words = lambda t: F.filter(F.split(F.lower(t), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(words(F.col("text")).alias("w"))
    return training.contained(items, docs, "item_id", "w").select("item_id", "contained")


@query("""WITH n AS (SELECT l_linestatus AS q, l_returnflag AS s, l_linenumber AS z, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY q, s) AS p FROM n),
  r AS (SELECT q, z, sum(n) / sum(sum(n)) OVER (PARTITION BY q) AS r FROM n GROUP BY q, z) SELECT q, s, round(sum(p * ln(p / r)), 9) AS kl FROM p JOIN r USING (q, z) GROUP BY q, s""")
def kl_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a response s moves the outcome z of a prompt q from its reference."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("q"), F.col("l_returnflag").alias("s"), F.col("l_linenumber").alias("z"))
    return rounded(information.kl(information.pmf(rows, ["z"], ["q", "s"]), information.pmf(rows, ["z"], ["q"]), ["q", "z"], ["q", "s"]), "kl", places=9)


# --- idea symbols and reports


@query(f"""WITH c AS ({_CENTROIDS}), ex AS ({O.spans('benchmark', 'item_id')}), sp AS (SELECT item_id, (generate_subscripts(spans, 1) - 1)::INTEGER AS pos, unnest(spans) AS span FROM ex), us AS (SELECT DISTINCT span FROM sp),
  tt AS (SELECT span, unnest(CASE WHEN len(regexp_extract_all(lower(span), '[a-z0-9]+')) = 0 THEN ['_empty_'] ELSE regexp_extract_all(lower(span), '[a-z0-9]+') END) AS tok FROM us),
  hh AS (SELECT span, sha256(i || ':' || tok) AS h FROM tt CROSS JOIN (SELECT unnest(range(8)) AS i)),
  ee AS (SELECT span, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 64 AS idx, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS val FROM hh GROUP BY 1, 2 HAVING sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) <> 0),
  en AS (SELECT span, idx, val / sqrt(sum(val * val) OVER (PARTITION BY span)) AS val FROM ee),
  pr AS (SELECT item_id, pos, span, 1 / (1 + exp(-4.0 * coalesce((SELECT sum(val) FROM en WHERE en.span = sp.span AND idx = 0), 0.0))) AS p FROM sp),
  cl AS (SELECT *, coalesce(lag((p > 0.5)::INT) OVER (PARTITION BY item_id ORDER BY pos), 0) AS k FROM pr),
  ie AS (SELECT *, sum(k) OVER (PARTITION BY item_id ORDER BY pos)::INTEGER AS idea FROM cl),
  ns AS (SELECT item_id, idea, count(*) AS m FROM ie GROUP BY ALL),
  me AS (SELECT item_id, idea, idx, sum(val) / any_value(m) AS val FROM ie JOIN en USING (span) JOIN ns USING (item_id, idea) GROUP BY ALL),
  ce AS (SELECT cid, unnest(range(64)) AS idx, unnest(c) AS cv FROM c),
  dd AS (SELECT item_id, idea, cid, sum(val * cv) AS xc FROM me JOIN ce USING (idx) GROUP BY ALL),
  c2 AS (SELECT cid, sum(cv * cv) AS c2 FROM ce GROUP BY cid)
  SELECT item_id, idea AS pos, 'c' || min_by(cid, c2 - 2 * xc) AS sym FROM dd JOIN c2 USING (cid) GROUP BY item_id, idea""")
def idea_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as codebook symbols: spans encoded, joined at the boundary detector's breaks, quantised."""
    e = table(spark, sf_dir, "embeddings")
    return ideas.idea_symbols(table(spark, sf_dir, "benchmark"), "item_id", "text", ideas.centroids_by(e, "label"), [4.0] + [0.0] * 63)


def _encoded(p: str, source: str) -> str:
    """CTEs {p}us (span) and {p}en (span, idx, val): the unit vectors of the distinct spans of ``source``."""
    sign = "sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE)"
    toks = "regexp_extract_all(lower(span), '[a-z0-9]+')"
    return f"""{p}us AS (SELECT DISTINCT span FROM {source}),
  {p}tt AS (SELECT span, tok, count(*) AS m FROM (SELECT span, unnest(CASE WHEN len({toks}) = 0 THEN ['_empty_'] ELSE {toks} END) AS tok FROM {p}us) GROUP BY span, tok),
  {p}hh AS (SELECT span, m, sha256(i || ':' || tok) AS h FROM {p}tt CROSS JOIN (SELECT unnest(range(8)) AS i)),
  {p}ee AS (SELECT span, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 64 AS idx, {sign.replace('END::DOUBLE', 'END::DOUBLE * m')} AS val FROM {p}hh GROUP BY 1, 2),
  {p}en AS (SELECT span, idx, val / sqrt(sum(val * val) OVER (PARTITION BY span)) AS val FROM {p}ee)"""


def _book(p: str, source: str, key: str) -> str:
    """CTE {p}sy (key, pos, sym): every span's nearest centroid, from ce (cid, idx, cv) and cc (cid, c2)."""
    return f"""{p}sp AS (SELECT {key}, (generate_subscripts(spans, 1) - 1)::INTEGER AS pos, unnest(spans) AS span FROM ({O.spans(source, key)})),
  {_encoded(p, p + 'sp')},
  {p}nn AS (SELECT span, 'c' || min_by(cid, d) AS sym FROM (SELECT span, cid, any_value(c2) - 2 * sum(val * cv) AS d FROM {p}en JOIN ce USING (idx) JOIN cc USING (cid) GROUP BY span, cid) GROUP BY span),
  {p}sy AS (SELECT {key}, pos, sym FROM {p}sp JOIN {p}nn USING (span))"""


_RECEIVED = f"""tk AS ({_TASKS}),
  sm AS (SELECT doc_id, id AS task, i AS variant, 'Context:' || chr(10) || substr(trim(text, {O.WS}), 1, 400) || chr(10) || chr(10) || 'Task:' || chr(10) || input || chr(10) || 'Variant-' || i || ': focus angle ' || i || '.' AS text
    FROM lt CROSS JOIN tk CROSS JOIN (SELECT unnest(range(4)) AS i)),
  sq AS (SELECT doc_id, task, variant, unnest(spans) AS span FROM ({O.spans('sm', 'doc_id, task, variant')})),
  {_encoded('r_', 'sq')},
  cnt AS (SELECT doc_id, task, variant, count(*) AS k FROM sq GROUP BY ALL),
  me AS (SELECT doc_id, task, variant, idx, sum(val) / any_value(k) AS val FROM sq JOIN r_en USING (span) JOIN cnt USING (doc_id, task, variant) GROUP BY ALL),
  x2 AS (SELECT doc_id, task, variant, sum(val * val) AS n2 FROM me GROUP BY ALL),
  dt AS (SELECT doc_id, task, variant, cid, sum(val * cv) AS xc FROM me JOIN ce USING (idx) GROUP BY ALL),
  dd AS (SELECT doc_id, task, variant, cid, sqrt(greatest(0, n2 + c2 - 2 * xc)) AS d FROM dt JOIN x2 USING (doc_id, task, variant) JOIN cc USING (cid)),
  sf AS (SELECT doc_id, task, cid, exp(-d) / sum(exp(-d)) OVER (PARTITION BY doc_id, task, variant) AS p FROM dd),
  sg AS (SELECT doc_id, task, -sum(q * ln(q + 1e-12)) AS h FROM (SELECT doc_id, task, cid, avg(p) AS q FROM sf GROUP BY ALL) GROUP BY ALL),
  rb AS (SELECT doc_id, greatest(0, least(1, avg(h) / ln((SELECT count(*) FROM cc)))) AS r_b FROM sg GROUP BY doc_id)"""

_TEAMS = """tw AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last, ln(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 1) + 1) AS h FROM conversations),
  tg AS (SELECT conv_id AS doc_id, coalesce(greatest(0.0, max(h) FILTER (turn = last) - max(h) FILTER (role = 'assistant' AND turn < last)), 0.0) AS g_k FROM tw GROUP BY conv_id)"""


@query(f"""WITH ce AS (SELECT cid, unnest(range(64)) AS idx, unnest(c) AS cv FROM ({_CENTROIDS})), cc AS (SELECT cid, sum(cv * cv) AS c2 FROM ce GROUP BY cid),
  lt AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id)), {_book('d_', 'lt', 'doc_id')}, sy AS (SELECT * FROM d_sy), {_book('b_', 'benchmark', 'item_id')}, ps AS (SELECT * FROM b_sy),
  pt AS ({O.padded('ps', 'item_id', '<s>')}),{O.model('pt')}, pp AS ({O.padded('ps', 'item_id')}), {O.TAILS}, {O.NOVELTY}, {O.BELIEFS}, {_RECEIVED}, {_TEAMS},
  sc AS (SELECT doc_id, domain, cue, round(coalesce(r_d, 0.0), 9) AS r_d, coalesce(r_b, 0.0) AS r_b, coalesce(g_k, 0.0) AS g_k, CASE WHEN g_k IS NULL THEN 0.0 ELSE 0.001 END::DOUBLE AS lam FROM cu LEFT JOIN rd USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN tg USING (doc_id))
  SELECT doc_id, domain, round(cue, 9) AS cue, round(r_d, 4) AS r_d, round(r_b, 6) AS r_b, round(g_k, 6) AS g_k, round((cue > 0)::INT * (r_d > 0)::INT * (cue * (1 + r_b) + lam * g_k), 9) AS score FROM sc""")
def team_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score of labelled documents: novelty of codebook symbols, expansion by the receiver, and the team's gain,
    for which the conversation of the same number stands."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings")
    centroids = materialize(ideas.centroids_by(e, "label").coalesce(1), "codebook")
    syms = materialize(ideas.idea_symbols(labelled, "doc_id", "text", centroids, tail=True), "symbols")
    probes = materialize(ideas.idea_symbols(table(spark, sf_dir, "benchmark"), "item_id", "text", centroids), "probes")
    model = C.train(probes, "item_id")
    r_d = lm.structural_novelty(lm.tails(syms), probes, model.p, model.b)
    r_b = C.receiver_expansion(labelled, C.battery(spark), centroids, centroids.count(), "doc_id")
    c = table(spark, sf_dir, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    g = records.length_gain(c, "conv_id", (F.col("role") == "assistant") & (F.col("turn") < F.col("last")), F.col("turn") == F.col("last")).select(F.col("conv_id").alias("doc_id"), "g_k")
    rows = scores.with_cue(C.beliefs(spark, sf_dir)).select("doc_id", F.col("lang").alias("domain"), "cue")
    rows = rows.join(r_d, "doc_id", "left").join(r_b, "doc_id", "left").join(g, "doc_id", "left")
    lam = M.effective_lambda(F.col("g_k").isNotNull(), 0.0, 0.001)
    rows = rows.select("doc_id", "domain", "cue", F.round(F.coalesce("r_d", F.lit(0.0)), 9).alias("r_d"), F.coalesce("r_b", F.lit(0.0)).alias("r_b"), F.coalesce("g_k", F.lit(0.0)).alias("g_k"), lam.alias("lam"))
    one = M.cue_gate(F.col("cue")) * M.novelty_gate(F.col("r_d"), 0.0) * (F.col("cue") * (1 + F.col("r_b")) + F.col("lam") * F.col("g_k"))
    return rows.select("doc_id", "domain", F.round("cue", 9).alias("cue"), F.round("r_d", 4).alias("r_d"), F.round("r_b", 6).alias("r_b"), F.round("g_k", 6).alias("g_k"), F.round(one, 9).alias("score"))


@query(f"""WITH d AS (SELECT lang AS domain, count(*) AS prompts, sum(ceil(length(text) / 4)::BIGINT)::BIGINT AS input_tokens, sum(ceil((length(text) + 200 + 3200) / 4)::BIGINT)::BIGINT AS judge_in FROM documents GROUP BY lang),
  g AS (SELECT domain, sum(input_tokens * p_in + prompts * 5 * 800 * p_out) AS gen_usd, max(prompts) AS prompts, any_value(judge_in) AS judge_in FROM d CROSS JOIN {_CATALOG_SQL} GROUP BY domain),
  j AS (SELECT *, judge_in * 5 * 1.5e-07::DOUBLE + prompts * 5 * 80 * 6e-07::DOUBLE AS judge_usd FROM g)
  SELECT domain, round(gen_usd, 4) AS gen_usd, round(judge_usd, 4) AS judge_usd, round(gen_usd + judge_usd, 4) AS total_usd, round((gen_usd + judge_usd) * CASE WHEN domain = 'en' THEN 3000.0::DOUBLE / prompts ELSE 1 END, 4) AS full_usd FROM j WHERE domain IS NOT NULL""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation, judging and totals by domain, scaled to full sets where their size is given."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    d = docs.groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("prompts"), F.sum(cost.judge_tokens(F.col("text"), 200, 800)).alias("judge_in"))
    judges = cost.judge_cost(d, spark.createDataFrame([("j1", 1.5e-07, 6e-07)], "model_id string, p_in double, p_out double"))
    full = spark.createDataFrame([("en", 3000)], "domain string, full_rows long")
    return rounded(cost.report(_costs(spark, sf_dir).where("domain is not null"), judges, full), "gen_usd", "judge_usd", "total_usd", "full_usd", places=4)


@query("SELECT lang AS domain, count(*) AS prompts, round(avg(ceil(length(text) / 4)), 6) AS mean_tokens FROM documents GROUP BY lang")
def mean_input_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cost.prompt_tokens(table(spark, sf_dir, "documents").withColumnRenamed("lang", "domain"), "domain", "text")
    return d.select("domain", "prompts", F.round("mean_tokens", 6).alias("mean_tokens"))


@query(f"""WITH sy AS ({O.symbols('documents', 'doc_id')}), pd AS ({O.padded('sy', 'doc_id', '<s>')}),{O.model('pd')},
  cx AS (SELECT DISTINCT n - 1 AS n, CASE WHEN n = 2 THEN '' ELSE string_split(ctx, ' ')[1] END AS ctx, string_split(ctx, ' ')[-1] AS w FROM pr WHERE n > 1),
  al AS (SELECT n, ctx, w, p FROM pr UNION ALL SELECT n, ctx, w, 1e-99 FROM cx WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.n = cx.n AND pr.ctx = cx.ctx AND pr.w = cx.w)),
  gr AS (SELECT n, trim(ctx || ' ' || w) AS gram, greatest(p, 1e-99) AS p FROM al)
  SELECT gr.n::INTEGER AS n, gram, round(log10(p), 6) AS log10p, CASE WHEN gr.n < 3 THEN round(coalesce(log10(bow), 0.0), 6) END AS log10bow FROM gr LEFT JOIN bo ON bo.n = gr.n AND bo.ctx = gram""")
def arpa_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.train(ideas.symbols(table(spark, sf_dir, "documents"), buckets=C.BUCKETS))
    return rounded(lm.arpa_entries(m.p, m.b), "log10p", "log10bow")


# --- streams, what the watermark has closed


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2)
  SELECT start, event_type, n, value_sum FROM w, m WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows from a stream; those that end by the watermark are complete and written."""
    e = streams.event_stream(spark, f"{sf_dir}/events.parquet*")
    out = streams.run_available(streams.windowed(e), f"closed_{uuid.uuid4().hex[:8]}")
    return rounded(out, "value_sum", places=4).withColumn("start", F.col("start").cast("timestamp_ntz"))
