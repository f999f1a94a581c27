"""Registered queries and the SQL each is compared with.

Each query applies an operator to whole driver tables. ``RELATIONAL`` names those that only show that plain
relational work passes through; the others re-express an operator of the scoring pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions import text as T
from noveltide.operators import corpus, cost, ideas, information, lm, records, scores, training, trajectory
from noveltide.streaming import trajectories as streams

from . import creativity as C
from . import oracle as O
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
RELATIONAL: set[str] = set()


def query(sql: str | None = None, relational: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        if relational:
            RELATIONAL.add(f.__name__)
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- gated score and reports


@query(f"""WITH {O.SCORED} SELECT domain, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(cue), 9) AS mean_cue, round(avg(r_d), 6) AS mean_r_d,
  round(avg(r_b), 6) AS mean_r_b, round(avg(((cue_gate > 0) AND (d_gate > 0))::INT), 6) AS gate_pass_rate FROM sc GROUP BY domain""")
def r_creativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.scored_documents(spark, sf_dir)
    both = ((F.col("cue_gate") > 0) & (F.col("d_gate") > 0)).cast("double")
    return rows.groupBy("domain").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg("cue"), 9).alias("mean_cue"), F.round(F.avg("r_d"), 6).alias("mean_r_d"),
        F.round(F.avg("r_b"), 6).alias("mean_r_b"), F.round(F.avg(both), 6).alias("gate_pass_rate"),
    )


@query(f"WITH {O.SCORED} SELECT doc_id, domain, round(cue, 9) AS cue, round(r_d, 6) AS r_d, round(r_b, 6) AS r_b, cue_gate, d_gate, round(score, 9) AS score FROM sc")
def r_creativity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.scored_documents(spark, sf_dir)
    return rounded(rounded(rows, "cue", "score", places=9), "r_d", "r_b").select("doc_id", "domain", "cue", "r_d", "r_b", "cue_gate", "d_gate", "score")


@query(f"""WITH {O.SCORED} SELECT count(*) AS n, round(avg(score), 9) AS mean_score, round(coalesce(stddev_samp(score), 0), 9) AS std_score,
  round(avg(score) - 1.96 * stddev_samp(score) / sqrt(count(*)), 9) AS ci95_low, round(avg(score) + 1.96 * stddev_samp(score) / sqrt(count(*)), 9) AS ci95_high,
  round(avg(cue), 9) AS mean_cue, round(avg(r_d), 6) AS mean_r_d, round(avg(r_b), 6) AS mean_r_b, avg(g_k) AS mean_g_k,
  round(avg((cue_gate > 0)::INT), 6) AS cue_gate_pass_rate, round(avg((d_gate > 0)::INT), 6) AS d_gate_pass_rate, round(avg((cue_gate > 0 AND d_gate > 0)::INT), 6) AS gate_pass_rate FROM sc""")
def report_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scores.report(C.scored_documents(spark, sf_dir))
    r = rounded(r, "mean_score", "std_score", "ci95_low", "ci95_high", "mean_cue", places=9)
    return rounded(r, "mean_r_d", "mean_r_b", "cue_gate_pass_rate", "d_gate_pass_rate", "gate_pass_rate")


@query(f"WITH {O.SCORED} SELECT domain, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg((cue_gate > 0 AND d_gate > 0)::INT), 6) AS gate_pass_rate FROM sc WHERE domain <> '' GROUP BY domain")
def report_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(scores.report_by_domain(C.scored_documents(spark, sf_dir)), "mean_score", places=9), "gate_pass_rate")


@query(f"WITH {O.BELIEFS} SELECT doc_id, domain, round(brier_delta, 9) AS brier_delta, round(cue, 9) AS cue, (cue > 0)::INT::DOUBLE AS cue_gate FROM cu")
def cue_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.with_cue(C.beliefs(spark, sf_dir)).withColumn("brier_delta", M.brier_delta(F.col("prior"), F.col("posterior"), F.col("outcome")))
    return rows.select("doc_id", F.col("lang").alias("domain"), F.round("brier_delta", 9).alias("brier_delta"), F.round("cue", 9).alias("cue"), M.cue_gate(F.col("cue")).alias("cue_gate"))


# --- text, contamination, dedup


@query(f"SELECT doc_id, sha256(regexp_replace(lower(trim(text, {O.WS})), '\\s+', ' ', 'g')) AS h, (octet_length(encode(text)) * 8)::DOUBLE AS bits, ceil(length(text) / 4)::BIGINT AS est_tokens FROM documents")
def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(t).alias("h"), T.bit_length_utf8(t).alias("bits"), T.estimate_tokens(t).alias("est_tokens"))


_NORM = f"regexp_replace(lower(trim(text, {O.WS})), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id FROM documents WHERE {_NORM} NOT IN (SELECT {_NORM} FROM benchmark)")
def decontaminate_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.decontaminate(table(spark, sf_dir, "documents"), corpus.banned_hashes(table(spark, sf_dir, "benchmark"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_NORM} IN (SELECT {_NORM} FROM benchmark)")
def probe_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.overlapping(table(spark, sf_dir, "documents"), corpus.banned_hashes(table(spark, sf_dir, "benchmark"))).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM documents),
  v AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM benchmark),
  g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM w WHERE len(ws) >= 8),
  h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM v WHERE len(ws) >= 8)
  SELECT doc_id, count(DISTINCT item_id) AS n_items, count(DISTINCT g) AS n_grams FROM g JOIN h USING (g) GROUP BY doc_id""")
def containment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    def grams(name: str, key: str) -> DataFrame:
        clean = F.regexp_replace(F.lower("text"), r"[^a-z0-9 \s]", "")
        ws = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
        d = table(spark, sf_dir, name).select(key, ws.alias("ws")).where(F.size("ws") >= 8)
        return d.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 7), lambda i: F.array_join(F.slice("ws", i, 8), " "))).alias("g"))

    hits = grams("documents", "doc_id").join(grams("benchmark", "item_id").distinct(), "g")
    return hits.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("g").alias("n_grams"))


@query(f"SELECT min(doc_id) AS doc_id, sha256({_NORM}) AS h FROM documents GROUP BY sha256({_NORM})")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], out="h").select("doc_id", "h")


_ACCOUNT = f"""WITH h AS (SELECT {_NORM} AS t, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT *, t IN (SELECT {_NORM} FROM benchmark) AS bad FROM h)
  SELECT sum(n)::BIGINT AS n_raw, count(*) FILTER (NOT bad) AS n_kept, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_contaminated, coalesce(sum(n - 1) FILTER (NOT bad), 0)::BIGINT AS n_duplicate FROM m"""


@query(_ACCOUNT)
def exclusion_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exclusion_accounting(table(spark, sf_dir, "documents"), corpus.banned_hashes(table(spark, sf_dir, "benchmark")))


@query(f"""SELECT a.*, k.kept_sample, b.banned_sample FROM ({_ACCOUNT}) a,
  (SELECT list(h ORDER BY h) AS kept_sample FROM (SELECT DISTINCT sha256({_NORM}) AS h FROM documents ORDER BY h LIMIT 5)) k,
  (SELECT list(h ORDER BY h) AS banned_sample FROM (SELECT DISTINCT sha256({_NORM}) AS h FROM benchmark ORDER BY h LIMIT 5)) b""")
def contamination_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, banned = table(spark, sf_dir, "documents"), corpus.banned_hashes(table(spark, sf_dir, "benchmark"))
    return corpus.manifest(corpus.exclusion_accounting(docs, banned), docs, banned)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 50""")
def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 50 documents of each language."""
    return corpus.seeded_subset(table(spark, sf_dir, "documents"), "doc_id", 42, 50, "lang").select("doc_id", "lang")


# --- ideas


@query(f"SELECT doc_id, (generate_subscripts(spans, 1) - 1)::INTEGER AS pos, unnest(spans) AS span FROM ({O.spans('documents', 'doc_id')})")
def segment_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideas.explode_ideas(table(spark, sf_dir, "documents"))


@query(f"SELECT lang, sum(len(spans))::BIGINT AS n_ideas, round(avg(len(spans)), 6) AS mean_ideas, max(len(spans))::BIGINT AS most_ideas FROM ({O.spans('documents', 'doc_id, lang')}) GROUP BY lang")
def idea_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.split_ideas(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.sum("n").alias("n_ideas"), F.round(F.avg("n"), 6).alias("mean_ideas"), F.max("n").alias("most_ideas"))


@query(f"""WITH sy AS ({O.symbols('documents', 'doc_id')}), g AS (SELECT sym AS a, lead(sym, 1) OVER w AS b, lead(sym, 2) OVER w AS c FROM sy WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1""")
def span_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.document_symbols(spark, sf_dir)
    return rows.select(F.explode(ideas.ngrams(F.col("syms"), 3)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM benchmark),
  h AS (SELECT item_id, sha256(i || ':' || tok) AS h FROM t CROSS JOIN (SELECT unnest(range(8)) AS i)),
  e AS (SELECT item_id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 64)::INTEGER AS idx,
    CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM h),
  v AS (SELECT item_id, idx, sum(s) AS val FROM e GROUP BY item_id, idx HAVING sum(s) <> 0)
  SELECT item_id, idx, round(val / sqrt(sum(val * val) OVER (PARTITION BY item_id)), 6) AS val FROM v""")
def hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ideas.hash_encode(table(spark, sf_dir, "benchmark"), ["item_id"], "text"), "val")


_CENTROIDS = """SELECT label AS cid, list(m / sqrt(n2) ORDER BY i) AS c FROM (SELECT label, i, m, sum(m * m) OVER (PARTITION BY label) AS n2 FROM
  (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY label, i)) GROUP BY label"""


@query(f"SELECT cid, (unnest(range(len(c))))::INTEGER AS idx, round(unnest(c), 6) AS val FROM ({_CENTROIDS})")
def codebook_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideas.centroids_by(table(spark, sf_dir, "embeddings"), "label").select("cid", F.posexplode("centroid").alias("idx", "val")).select("cid", "idx", F.round("val", 6).alias("val"))


@query(f"""WITH c AS ({_CENTROIDS}), d AS (SELECT vec_id, cid, list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - c[i], 2))) AS d2 FROM embeddings CROSS JOIN c)
  SELECT vec_id, min_by(cid, d2) AS cid, round(min(d2), 9) AS dist2 FROM d GROUP BY vec_id""")
def quantize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rounded(ideas.quantize(e, ideas.centroids_by(e, "label")).select("vec_id", "cid", "dist2"), "dist2", places=9)


@query("SELECT label, (i - 1)::INTEGER AS idx, round(avg(v::DOUBLE), 6) AS val FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY label, i")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ideas.mean_pool(table(spark, sf_dir, "embeddings"), ["label"]), "val")


def _soft(temperature: float) -> str:
    return f"""WITH c AS ({_CENTROIDS}), d AS (SELECT vec_id, label, cid, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - c[i], 2)))) AS d FROM embeddings CROSS JOIN c),
  p AS (SELECT label, cid, exp(-d / {temperature}) / sum(exp(-d / {temperature})) OVER (PARTITION BY vec_id) AS p FROM d),
  q AS (SELECT label, cid, avg(p) AS q FROM p GROUP BY label, cid),
  h AS (SELECT label, -sum(q * ln(q + 1e-12)) AS entropy FROM q GROUP BY label)"""


@query(f"{_soft(1.0)} SELECT label, round(entropy, 6) AS entropy FROM h")
def soft_cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rounded(ideas.soft_entropy(e, ["label"], ideas.centroids_by(e, "label")), "entropy")


@query(f"{_soft(0.05)} SELECT label, round(greatest(0, least(1, entropy / ln((SELECT count(*) FROM c)))), 6) AS r_b FROM h")
def soft_expansion_sharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver expansion at a low temperature, where it tells labels apart."""
    e = table(spark, sf_dir, "embeddings")
    centroids = ideas.centroids_by(e, "label")
    k = e.select("label").distinct().count()
    return rounded(ideas.normalized_expansion(ideas.soft_entropy(e, ["label"], centroids, 0.05), ["label"], k), "r_b")


_TASKS = " UNION ALL ".join(f"SELECT '{i}' AS id, '{t}' AS input" for i, t in [
    ("t1", "Continue in two sentences a story about a lighthouse that forgets its sailors."),
    ("t2", "Name three things to measure in a study of moss on city walls."),
    ("t3", "State the next step after showing that a sum of two even numbers is even."),
    ("t4", "Invent a custom for a town that trades in echoes."),
])


@query(f"""WITH c AS ({_CENTROIDS}), tk AS ({_TASKS}),
  sm AS (SELECT item_id, id AS task, i AS variant, 'Context:' || chr(10) || substr(trim(text, {O.WS}), 1, 400) || chr(10) || chr(10) || 'Task:' || chr(10) || input || chr(10) || 'Variant-' || i || ': focus angle ' || i || '.' AS text
    FROM benchmark CROSS JOIN tk CROSS JOIN (SELECT unnest(range(4)) AS i)),
  sp AS (SELECT item_id, task, variant, unnest(spans) AS span FROM ({O.spans('sm', 'item_id, task, variant')})),
  us AS (SELECT DISTINCT span FROM sp),
  tt AS (SELECT span, unnest(CASE WHEN len(regexp_extract_all(lower(span), '[a-z0-9]+')) = 0 THEN ['_empty_'] ELSE regexp_extract_all(lower(span), '[a-z0-9]+') END) AS tok FROM us),
  hh AS (SELECT span, sha256(i || ':' || tok) AS h FROM tt CROSS JOIN (SELECT unnest(range(8)) AS i)),
  ee AS (SELECT span, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 64 AS idx, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS val FROM hh GROUP BY 1, 2),
  en AS (SELECT span, idx, val / sqrt(sum(val * val) OVER (PARTITION BY span)) AS val FROM ee),
  cnt AS (SELECT item_id, task, variant, count(*) AS k FROM sp GROUP BY ALL),
  me AS (SELECT item_id, task, variant, idx, sum(val) / any_value(k) AS val FROM sp JOIN en USING (span) JOIN cnt USING (item_id, task, variant) GROUP BY ALL),
  ce AS (SELECT cid, unnest(range(64)) AS idx, unnest(c) AS cv FROM c),
  x2 AS (SELECT item_id, task, variant, sum(val * val) AS n2 FROM me GROUP BY ALL),
  dt AS (SELECT item_id, task, variant, cid, sum(val * cv) AS xc FROM me JOIN ce USING (idx) GROUP BY ALL),
  c2 AS (SELECT cid, sum(cv * cv) AS c2 FROM ce GROUP BY cid),
  dd AS (SELECT item_id, task, variant, cid, sqrt(greatest(0, n2 + c2 - 2 * xc)) AS d FROM dt JOIN x2 USING (item_id, task, variant) JOIN c2 USING (cid)),
  p AS (SELECT item_id, task, cid, exp(-d) / sum(exp(-d)) OVER (PARTITION BY item_id, task, variant) AS p FROM dd),
  q AS (SELECT item_id, task, cid, avg(p) AS q FROM p GROUP BY ALL),
  h AS (SELECT item_id, task, -sum(q * ln(q + 1e-12)) AS entropy FROM q GROUP BY ALL)
  SELECT item_id, round(greatest(0, least(1, avg(entropy) / ln((SELECT count(*) FROM c)))), 6) AS r_b FROM h GROUP BY item_id""")
def receiver_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = e.select("label").distinct().count()
    return rounded(C.receiver_expansion(table(spark, sf_dir, "benchmark"), C.battery(spark), ideas.centroids_by(e, "label"), k, "item_id"), "r_b")


@query()
def kmeans_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideas.train_codebook(table(spark, sf_dir, "embeddings"), 10).select("cid", F.round(M.dot(F.col("centroid"), F.col("centroid")), 6).alias("norm2"))


@query("""WITH p AS (SELECT vec_id, label, 1 / (1 + exp(-(embedding[1]::DOUBLE * 4.0 + 0.5))) AS p FROM embeddings),
  f AS (SELECT *, coalesce(lag((p > 0.5)::INT) OVER (PARTITION BY label ORDER BY vec_id), 0) AS c FROM p),
  g AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY vec_id) AS idea FROM f)
  SELECT label, idea::INTEGER AS idea, string_agg(vec_id::VARCHAR, ' ' ORDER BY vec_id) AS text FROM g GROUP BY label, idea""")
def boundary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in order stand for the spans of a text."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("span"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    e = e.withColumn("p", M.sigmoid(F.get("embedding", F.lit(0)) * 4.0 + 0.5))
    return ideas.merge_spans(e, "label").select("label", "idea", "text")


# --- n-gram model


_DOC_MODEL = f"sy AS ({O.symbols('documents', 'doc_id')}), pd AS ({O.padded('sy', 'doc_id', '<s>')}),{O.model('pd')}"


@query(f"WITH {_DOC_MODEL} SELECT n::INTEGER AS n, ctx, w, c::BIGINT AS c FROM cn")
def ngram_lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.counts(ideas.symbols(table(spark, sf_dir, "documents"), buckets=C.BUCKETS))


@query(f"WITH {_DOC_MODEL} SELECT n::INTEGER AS n, ctx, w, round(log2(p), 6) AS log2p FROM pr")
def witten_bell_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.train(ideas.symbols(table(spark, sf_dir, "documents"), buckets=C.BUCKETS))
    return m.p.select("n", "ctx", "w", F.round(F.log2("p"), 6).alias("log2p"))


@query(f"WITH {_DOC_MODEL} SELECT n::INTEGER AS n, ctx, round(log2(bow), 6) AS log2bow FROM bo")
def backoff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.train(ideas.symbols(table(spark, sf_dir, "documents"), buckets=C.BUCKETS))
    return m.b.select("n", "ctx", F.round(F.log2("bow"), 6).alias("log2bow"))


@query(f"WITH sy AS ({O.symbols('documents', 'doc_id')}), sd AS ({O.padded('sy', 'doc_id')}), {O.PROBE_MODEL} SELECT doc_id, round(sum(bits), 4) AS bits FROM ({O.bits('sd', 'doc_id')}) GROUP BY doc_id")
def sequence_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = C.probe_model(spark, sf_dir)
    return rounded(lm.sequence_bits(ideas.symbols(table(spark, sf_dir, "documents"), buckets=C.BUCKETS), m.p, m.b), "bits", places=4)


@query(f"WITH sy AS ({O.symbols('documents', 'doc_id')}), {O.PROBE_MODEL}, {O.TAILS}, {O.NOVELTY} SELECT t1, t2, round(r_d, 5) AS r_d FROM rt")
def context_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The novelty of every state that documents leave the model in."""
    probes, m = C.probe_model(spark, sf_dir)
    tails = lm.array_tails(C.document_symbols(spark, sf_dir), "doc_id", "syms")
    states = tails.select("t1", "t2").distinct()
    return rounded(lm.novelty_by_tail(tails, probes, m.p, m.b).join(states, ["t1", "t2"], "left_semi"), "r_d", places=5)


@query(f"WITH sy AS ({O.symbols('documents', 'doc_id')}), {O.PROBE_MODEL}, {O.TAILS}, {O.NOVELTY} SELECT doc_id, round(r_d, 5) AS r_d FROM rd")
def structural_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.document_novelty(spark, sf_dir), "r_d", places=5)


@query(f"""WITH sy AS ({O.symbols('documents', 'doc_id')}), {O.PROBE_MODEL}, {O.TAILS}, {O.NOVELTY},
  k AS (SELECT lang, CASE WHEN quality = 1 THEN 're' ELSE 'pa' END AS kind, r_d FROM rd JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
  a AS (SELECT lang, max(r_d) FILTER (kind = 'pa') AS hi, min(r_d) FILTER (kind = 're') AS lo, avg(r_d) FILTER (kind = 'pa') AS pm, avg(r_d) FILTER (kind = 're') AS rm, list(r_d ORDER BY r_d) FILTER (kind = 'pa') AS p FROM k GROUP BY lang)
  SELECT lang, lo > hi AS separable, round(CASE WHEN lo > hi THEN 0.5 * (hi + lo) ELSE p[floor(0.9 * (len(p) - 1))::INT + 1] + 0.001 END, 5) AS delta_d, round(pm, 5) AS paraphrase_mean, round(rm, 5) AS restructure_mean FROM a""")
def delta_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: novelty of weak texts stands for the paraphrases', of good ones for the restructures'."""
    docs = table(spark, sf_dir, "documents")
    r = C.document_novelty(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = r.select("lang", F.when(F.col("quality") == 1, "restructure").otherwise("paraphrase").alias("kind"), "r_d")
    out = scores.calibrate_delta(rows, ["lang"])
    return rounded(out, "delta_d", "paraphrase_mean", "restructure_mean", places=5)


@query("""SELECT item_id, variant, text FROM (SELECT item_id, 'para_copy' AS variant, text FROM benchmark
  UNION ALL SELECT item_id, 'para_minor', CASE WHEN contains(text, 'Propose') OR contains(text, 'Write') THEN replace(replace(text, 'Propose', 'Suggest'), 'Write', 'Compose') ELSE 'In short: ' || text END FROM benchmark
  UNION ALL SELECT item_id, 'para_wrap', 'Here is the same request restated: ' || text FROM benchmark)""")
def paraphrase_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.paraphrases(table(spark, sf_dir, "benchmark")).select("item_id", "variant", F.col("variant_text").alias("text"))


# --- beliefs, records, trajectories


@query("""SELECT event_id, CASE WHEN coalesce((props->>'k')::DOUBLE, 0) > 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS p_k, CASE WHEN coalesce((props->>'k')::DOUBLE, 0) > 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS p_none FROM events""")
def belief_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.parse_beliefs(F.col("props"), ["k", "a_b", "c", "d"])
    return table(spark, sf_dir, "events").select("event_id", F.round(F.get(p, F.lit(0)), 6).alias("p_k"), F.round(F.get(p, F.lit(1)), 6).alias("p_none"))


_STEPS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, turn, text, ln(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 1) + 1) AS v FROM conversations WHERE role = 'assistant'"


@query("SELECT conv_id, min_by(text, turn) FILTER (role = 'user' AND text <> '') AS prompt FROM conversations GROUP BY conv_id")
def first_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("role") == "user") & (F.col("text") != "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.when(ok, F.col("text")), F.when(ok, F.col("turn"))).alias("prompt"))


@query(f"SELECT conv_id, t::INTEGER AS t, round(v, 6) AS v FROM ({_STEPS})")
def trajectory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_points(spark, sf_dir), "v")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    t = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", t.alias("t"), M.length_entropy(F.col("text")).alias("v"))


@query(f"""WITH s AS ({_STEPS}), n AS (SELECT *, lead(v) OVER (PARTITION BY conv_id ORDER BY t) - v AS d FROM s), m AS (SELECT *, lead(d) OVER (PARTITION BY conv_id ORDER BY t) AS e FROM n),
  g AS (SELECT conv_id, count(*) AS n_points, min_by(d, t) AS f, count(*) FILTER (d = 0) AS flat, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (sign(d) * sign(e) < 0) AS turns FROM m GROUP BY conv_id)
  SELECT conv_id, n_points, CASE WHEN n_points >= 3 AND f > 0 AND flat = 0 AND down > 0 AND turns = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS dc,
    CASE WHEN n_points >= 3 AND f > 0 AND flat = 0 AND down > 0 AND turns = 1 THEN up END::INTEGER AS peak_index FROM g""")
def diverge_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.diverge_converge(_points(spark, sf_dir), "conv_id")


@query(f"""WITH s AS ({_STEPS}), n AS (SELECT conv_id, t, lead(v) OVER (PARTITION BY conv_id ORDER BY t) - v AS r FROM s)
  SELECT conv_id, t::INTEGER AS t, round(r, 6) AS reward, round(sum(r) OVER (PARTITION BY conv_id ORDER BY t), 6) AS total FROM n WHERE r IS NOT NULL""")
def step_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.step_rewards(_points(spark, sf_dir), "conv_id"), "reward", "total")


@query()
def step_cue_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.step_cue_fit(_points(spark, sf_dir), "conv_id")


@query(f"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
  h AS (SELECT conv_id, turn, role, last, ln(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 1) + 1) AS h FROM conversations JOIN l USING (conv_id)),
  g AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn < last) AS n_agents, max(h) FILTER (role = 'assistant' AND turn < last) AS b, max(h) FILTER (turn = last) AS j FROM h GROUP BY conv_id)
  SELECT conv_id, n_agents, round(j, 6) AS h_joint, round(coalesce(greatest(0.0, j - b), 0.0), 6) AS g_k FROM g""")
def length_entropy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are the agents, the last turn the joint text."""
    c = table(spark, sf_dir, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    g = records.length_gain(c, "conv_id", (F.col("role") == "assistant") & (F.col("turn") < F.col("last")), F.col("turn") == F.col("last"))
    return rounded(g.select("conv_id", "n_agents", "h_joint", "g_k"), "h_joint", "g_k")


@query("""WITH r AS (SELECT doc_id, 'quality' AS criterion, quality::DOUBLE AS x FROM labels UNION ALL SELECT doc_id, 'safety', 1.0 - toxic FROM labels),
  o AS (SELECT doc_id, 'overall' AS criterion, avg(x) AS x FROM r GROUP BY doc_id) SELECT criterion, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT * FROM r UNION ALL SELECT * FROM o) GROUP BY criterion""")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    r = labels.select("doc_id", F.lit("j1").alias("judge"), F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("safety"), 1.0 - F.col("toxic"))).alias("criterion", "rating"))
    return rounded(scores.judge_means(r, "doc_id"), "mean")


# --- cost


_CATALOG_SQL = "(VALUES " + ", ".join(f"('{m}', '{f}', '{p}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for m, f, p, a, b in cost.CATALOG) + ") AS m(model_id, family, provider, p_in, p_out)"
_COST_SQL = f"""WITH d AS (SELECT lang AS domain, count(*) AS prompts, sum(ceil(length(text) / 4)::BIGINT)::BIGINT AS input_tokens FROM documents GROUP BY lang),
  g AS (SELECT *, prompts * 5 AS gen_calls, input_tokens * p_in + prompts * 5 * 800 * p_out AS gen_usd FROM d CROSS JOIN {_CATALOG_SQL})"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cost.prompt_tokens(table(spark, sf_dir, "documents").withColumnRenamed("lang", "domain"), "domain", "text")
    return cost.generation_cost(d, cost.catalog(spark))


@query(f"{_COST_SQL} SELECT domain, model_id, input_tokens, gen_calls, round(gen_usd, 6) AS gen_usd FROM g")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_costs(spark, sf_dir).select("domain", "model_id", "input_tokens", "gen_calls", "gen_usd"), "gen_usd")


@query(f"{_COST_SQL} SELECT provider, family, round(sum(gen_usd), 6) AS gen_usd, sum(gen_calls)::BIGINT AS gen_calls, count(gen_usd) AS priced_rows FROM g GROUP BY provider, family")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.rollup(_costs(spark, sf_dir)), "gen_usd")


@query(f"{_COST_SQL} SELECT round(sum(gen_usd), 6) AS sample_usd, round(sum(gen_usd * 30.0::DOUBLE), 6) AS full_usd FROM g")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.project(_costs(spark, sf_dir), 30.0), "sample_usd", "full_usd")


@query(f"""{_COST_SQL} SELECT domain, model_id, CASE WHEN gen_calls <= 50 THEN 'free' WHEN gen_calls <= 500 THEN 'pro' ELSE 'max' END AS tier, floor(gen_calls * (300.0::DOUBLE / greatest(prompts, 1)))::BIGINT AS projected_calls,
  CASE WHEN gen_usd < 0.01 THEN printf('$%.6f', gen_usd) ELSE printf('$%.4f', gen_usd) END AS usd FROM g""")
def quota_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _costs(spark, sf_dir)
    return g.select("domain", "model_id", cost.quota_tier(F.col("gen_calls")).alias("tier"), cost.projected_calls(F.col("gen_calls"), F.col("prompts"), F.lit(300.0)).alias("projected_calls"), T.format_usd(F.col("gen_usd")).alias("usd"))


# --- information and training signals


@query("""WITH c AS (SELECT event_type AS z, user_id % 50 AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY z) AS t FROM c)
  SELECT z, sum(n)::BIGINT AS n, count(*) AS support, round(-sum(n / t * ln(n / t)), 6) AS h, round(count(*) / (2.0::DOUBLE * sum(n)), 6) AS bias_bound, round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS h_normalized FROM t GROUP BY z""")
def plugin_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("z"), (F.col("user_id") % 50).alias("y"))
    return rounded(information.entropy_with_bias(rows, ["y"], ["z"]), "h", "bias_bound", "h_normalized")


@query(f"""WITH sy AS (SELECT s.*, lang FROM ({O.symbols('documents', 'doc_id')}) s JOIN documents USING (doc_id)), q AS (SELECT sym, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM sy GROUP BY sym),
  p AS (SELECT lang, sym, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS p FROM sy GROUP BY lang, sym) SELECT lang, round(sum(p * ln(p / q)), 6) AS kl FROM p JOIN q USING (sym) GROUP BY lang""")
def kl_surface_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = ideas.symbols(docs, buckets=C.BUCKETS).join(docs.select("doc_id", "lang"), "doc_id")
    return rounded(information.kl(information.pmf(s, ["sym"], ["lang"]), information.pmf(s, ["sym"]), ["sym"], ["lang"]), "kl")


@query("""WITH k AS (SELECT l_returnflag AS y, l_shipdate::DATE AS z, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT y, z, n / sum(n) OVER (PARTITION BY y) AS p FROM k),
  w AS (SELECT y, sum(n) / sum(sum(n)) OVER () AS pi FROM k GROUP BY y), m AS (SELECT z, sum(pi * p) AS p FROM p JOIN w USING (y) GROUP BY z) SELECT count(*) AS support, round(-sum(p * ln(p)), 6) AS h FROM m""")
def mixture_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.to_date("l_shipdate").alias("z"))
    m = information.mixture(information.pmf(rows, ["y"]).select("y", F.col("p").alias("pi")), information.pmf(rows, ["z"], ["y"]), "y", "z")
    return m.agg(F.count("*").alias("support"), F.round(F.sum(M.plogp(F.col("p"))), 6).alias("h"))


def _h(cols: str, name: str) -> str:
    return f"(SELECT -sum(p * ln(p)) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY {cols})) AS {name}"


@query(f"""SELECT round(h_ab, 6) AS h_ab, round(h_ac, 6) AS h_ac, round(h_bc, 6) AS h_bc, round(h_abc, 6) AS h_abc, round(h_ab + h_ac + h_bc - h_abc, 6) AS o_info FROM
  (SELECT {_h('l_returnflag, l_linestatus', 'h_ab')}, {_h('l_returnflag, l_linenumber', 'h_ac')}, {_h('l_linestatus, l_linenumber', 'h_bc')}, {_h('l_returnflag, l_linestatus, l_linenumber', 'h_abc')})""")
def o_information3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = information.o_information3(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")
    return rounded(o, *o.columns)


@query(f"""SELECT round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(h_ab, 6) AS h_ab, round(h_a + h_b - h_ab, 6) AS mutual_info, round(h_ab - greatest(h_a, h_b), 6) AS gain FROM
  (SELECT {_h('l_returnflag', 'h_a')}, {_h('l_linestatus', 'h_b')}, {_h('l_returnflag, l_linestatus', 'h_ab')})""")
def pair_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = information.pair_information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(o, *o.columns)


@query("""WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY o_custkey)
  SELECT o_orderkey, round(CASE WHEN s > 0 THEN (o_totalprice - m) / (s + 1e-8) ELSE 0.0 END, 5) AS advantage FROM orders JOIN m USING (o_custkey)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.group_advantage(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "advantage"), "advantage", places=5)


@query("""WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), g AS (SELECT o_custkey, max(o_totalprice) FILTER (k = 1) AS r1, max(o_totalprice) FILTER (k = 2) AS r2 FROM r WHERE k <= 2 GROUP BY o_custkey)
  SELECT o_custkey, r1, r2, round(sign(r1 - r2) / sqrt(2.0), 6) AS a1, round(-sign(r1 - r2) / sqrt(2.0), 6) AS a2 FROM g WHERE r2 IS NOT NULL""")
def two_rollout_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.two_rollout_advantage(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice"), "a1", "a2")


@query("""SELECT z, sigma, round(m, 6) AS mean_length, round(ln(z) / (110 * ln(sigma) * m), 9) AS lambda_d FROM (SELECT count(DISTINCT event_type) AS z, count(DISTINCT user_id) AS sigma, avg(length(props)) AS m FROM events)""")
def lambda_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("n", F.length("props"))
    return rounded(rounded(training.lambda_d(e, "event_type", 110, "user_id", "n"), "lambda_d", places=9), "mean_length")


@query("""SELECT l_linenumber AS checkpoint, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS rho, corr(l_quantity, l_extendedprice) >= 0.5 AS ok FROM lineitem GROUP BY l_linenumber""")
def proxy_monitor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.proxy_monitor(table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "checkpoint"), "checkpoint", "l_quantity", "l_extendedprice", 0.5), "rho")


@query("""SELECT a.l_orderkey, a.l_linenumber AS winner, b.l_linenumber AS loser, round(a.l_extendedprice - b.l_extendedprice, 2) AS gap FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_extendedprice > b.l_extendedprice + 2 * 1000""")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.valid_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", 1000.0), "gap", places=2)


@query("""SELECT a.l_orderkey, count(*) FILTER (a.l_quantity > b.l_quantity) AS n_pairs, count(*) FILTER (a.l_quantity > b.l_quantity AND a.l_extendedprice < b.l_extendedprice) AS n_reversed,
  round(1 - count(*) FILTER (a.l_quantity > b.l_quantity AND a.l_extendedprice < b.l_extendedprice) / count(*) FILTER (a.l_quantity > b.l_quantity)::DOUBLE, 6) AS concordance FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY a.l_orderkey HAVING count(*) FILTER (a.l_quantity > b.l_quantity) > 0""")
def rank_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.rank_reversals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice"), "concordance")


@query("""SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal AND b.s_suppkey >= a.s_suppkey)""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.pareto_frontier(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey", "s_nationkey").select("s_suppkey")


@query("""WITH e AS (SELECT o_custkey, o_orderkey, o_totalprice, exp((o_totalprice - max(o_totalprice) OVER (PARTITION BY o_custkey)) / 50000) AS e FROM orders), p AS (SELECT *, e / sum(e) OVER (PARTITION BY o_custkey) AS pi FROM e)
  SELECT o_custkey, round(sum(pi * o_totalprice), 4) AS expected_reward FROM p GROUP BY o_custkey""")
def expected_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = training.softmax_policy(table(spark, sf_dir, "orders").withColumn("logit", F.col("o_totalprice") / 50000), "o_custkey", "logit")
    return rounded(training.expected_reward(p, "o_custkey", "o_totalprice"), "expected_reward", places=4)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN l_extendedprice ELSE 0.0 END::DOUBLE AS reward, CASE WHEN l_discount > 0.05 THEN 'expanding' WHEN l_discount < 0.05 THEN 'clarifying' ELSE 'neither' END AS label FROM lineitem""")
def feasibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", M.feasible_reward(F.col("l_quantity"), 25.0, F.col("l_extendedprice")).alias("reward"), M.expansion_label(F.col("l_discount"), 0.05).alias("label"))


# --- verdicts, gates, pairs and protocol checks


@query("""SELECT doc_id, quality = 1 AND toxic = 0 AS approved, toxic = 0 AS task_valid, 'open point' AS feedback FROM labels""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a verifier's JSON inside prose, and read back."""
    answer = F.to_json(F.struct(F.when(F.col("quality") == 1, "Approve ").otherwise("NOT APPROVED").alias("verdict"), (F.col("toxic") == 0).alias("task_valid"), F.lit(True).alias("addresses_critique"), F.array(F.lit("open point")).alias("unresolved_issues")))
    v = records.with_verdict(table(spark, sf_dir, "labels").withColumn("answer", F.concat(F.lit("My verdict: "), answer)), "answer")
    return v.select("doc_id", "verdict.approved", "verdict.task_valid", "feedback")


@query("""SELECT doc_id, (quality + 2 * toxic)::INTEGER AS outcome FROM labels""")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in scores.LABELS])
    at = F.col("quality") + 2 * F.col("toxic")
    answer = F.when(at % 2 == 0, F.to_json(F.struct(F.get(names, at).alias("label")))).otherwise(F.concat(F.lit("I would say "), F.get(names, at)))
    return table(spark, sf_dir, "labels").select("doc_id", T.classify_outcome(answer, scores.LABELS).alias("outcome"))


@query("""SELECT doc_id, round(abs(quality - toxic * 0.5) * ln(2) / greatest(octet_length(encode(text)) * 8, 8), 9) AS stub, CASE WHEN source = 'src0' THEN 0.0 WHEN toxic * 0.25 > 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS lambda FROM documents JOIN labels USING (doc_id)""")
def stub_and_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plumbing values: the stub gain, and the team weight in force."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    stub = M.stub_cue(F.col("quality") - F.col("toxic") * 0.5, T.bit_length_utf8(F.col("text")))
    return rows.select("doc_id", F.round(stub, 9).alias("stub"), M.effective_lambda(F.col("source") != "src0", F.col("toxic") * 0.25, 1.0).alias("lambda"))


@query("""SELECT a.l_orderkey, count(b.l_orderkey) AS n_pairs FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_extendedprice < a.l_extendedprice - 2000 GROUP BY a.l_orderkey""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.pair_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", 1000.0)


@query("""WITH p AS (SELECT a.o_orderkey AS w, b.o_orderkey AS l FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_totalprice > b.o_totalprice + 20000),
  m AS (SELECT w AS o_orderkey, 0.1 AS s FROM p UNION ALL SELECT l, -0.1 FROM p)
  SELECT o_orderkey, round(coalesce(sum(s), 0)::DOUBLE, 6) AS logit FROM orders LEFT JOIN m USING (o_orderkey) GROUP BY o_orderkey""")
def logit_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lit(0.0).alias("logit"))
    return rounded(training.logit_update(o, "o_custkey", "o_totalprice", 10000.0, "logit", 0.1).select("o_orderkey", "logit"), "logit")


@query("""SELECT l_orderkey, l_linenumber, round(0.1 * (ln((l_quantity / 60) / 0.5) - ln((1 - l_quantity / 60) / 0.5)), 6) AS log_odds FROM lineitem""")
def dpo_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_quantity") / 60
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(training.dpo_log_odds(p, 1 - p, F.lit(0.5), F.lit(0.5), 0.1), 6).alias("log_odds"))


@query("""SELECT NOT coalesce(bool_or(k = n), false) AS rotates FROM (SELECT user_id, count(DISTINCT ts::DATE) AS k FROM events GROUP BY user_id), (SELECT count(DISTINCT ts::DATE) AS n FROM events)""")
def probes_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for probes, days for batches."""
    return training.probes_rotate(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("""SELECT coalesce(max(p_size / 50.0::DOUBLE) < 0.99, true) AS tight FROM part WHERE p_retailprice >= 1000 AND p_size % 2 = 1""")
def tau_tightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 1000 * 0.99).alias("u"), (F.col("p_size") / 50.0).alias("h"), (F.col("p_size") % 2 == 0).alias("coherent"))
    return information.tau_tight(m, 0.99)


@query(f"""SELECT x, y, round(ha + hb - hab, 6) AS mutual_info, ha + hb - hab <= 0.001 AS independent FROM (
  SELECT 'l_returnflag' AS x, 'l_linestatus' AS y, {_h('l_returnflag', 'ha')}, {_h('l_linestatus', 'hb')}, {_h('l_returnflag, l_linestatus', 'hab')} UNION ALL
  SELECT 'l_linestatus', 'l_linenumber', {_h('l_linestatus', 'ha')}, {_h('l_linenumber', 'hb')}, {_h('l_linestatus, l_linenumber', 'hab')})""")
def product_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = information.product_kernel(table(spark, sf_dir, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber")], 0.001)
    return rounded(k, "mutual_info")


@query("""WITH a AS (SELECT l_returnflag AS x, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), b AS (SELECT l_linenumber AS y, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1) SELECT x, y, round(a.p * b.p, 9) AS p FROM a CROSS JOIN b""")
def joint_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(information.joint_product(information.pmf(li, ["l_returnflag"]).select("l_returnflag", "p"), information.pmf(li, ["l_linenumber"]).select("l_linenumber", "p")), "p", places=9)


@query("""WITH d AS (SELECT lang AS domain, count(*) AS prompts, sum(ceil((length(text) + 200 + 3200) / 4)::BIGINT)::BIGINT AS judge_in FROM documents GROUP BY lang)
  SELECT domain, round(sum(judge_in * 5 * p_in + prompts * 5 * 80 * p_out), 4) AS judge_usd FROM d CROSS JOIN (VALUES (1.5e-07::DOUBLE, 6e-07::DOUBLE), (2e-06::DOUBLE, 8e-06::DOUBLE)) j(p_in, p_out) GROUP BY domain""")
def judge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("prompts"), F.sum(cost.judge_tokens(F.col("text"), 200, 800)).alias("judge_in"))
    judges = spark.createDataFrame([("j1", 1.5e-07, 6e-07), ("j2", 2e-06, 8e-06), ("j3", None, None)], "model_id string, p_in double, p_out double")
    return rounded(cost.judge_cost(d, judges), "judge_usd", places=4)


@query("""SELECT s_name AS model_id, n_name IS NOT NULL AS available FROM (SELECT 'm' || s_nationkey || ':' || s_suppkey AS s_name, s_nationkey FROM supplier) LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3""")
def model_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("s_suppkey").cast("string")).alias("model_id"))
    names = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("name"))
    return cost.available(models, names).select("model_id", "available")


@query("""SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))""")
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, domain and group figures in one pass."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("noveltide_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM noveltide_documents GROUP BY GROUPING SETS ((), (lang), (lang, source))")


@query("""WITH r AS (SELECT conv_id, map([turn::VARCHAR], [text]) AS m, turn, role FROM conversations), f AS (SELECT conv_id, min_by(text, turn) AS first FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, text AS second FROM conversations WHERE turn = 1)
  SELECT conv_id, coalesce(second, first) AS response FROM f LEFT JOIN k USING (conv_id)""")
def response_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response under key '1' of a conversation's turns, else its first."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: F.create_map(x["turn"].cast("string"), x["text"])).alias("responses"))
    return c.select("conv_id", records.response_text(c, "1").alias("response"))


_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, value FROM (SELECT event_id, min(ts) AS ts, any_value(event_type) AS event_type, any_value(value) AS value FROM events GROUP BY event_id))
  WHERE start + INTERVAL 1 HOUR <= {_MARK} GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows from a stream without repeats: those that the watermark has closed; later ones wait for it."""
    import uuid

    e = streams.without_repeats(streams.event_stream(spark, f"{sf_dir}/events.parquet*"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    out = streams.run_available(g.select(F.col("window.start").alias("start"), "event_type", "n", "value_sum"), f"windows_{uuid.uuid4().hex[:8]}")
    return rounded(out, "value_sum", places=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- pages


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html)::INTEGER AS n_chars FROM pages""")
def extract_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n_chars"))


# --- streaming


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(streams.windowed(e, late=None), "value_sum", places=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS value_sum FROM s GROUP BY user_id, k"""


@query(_SESSIONS)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = rounded(streams.sessions(e, late=None), "value_sum", places=4)
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f'SELECT * FROM ({_SESSIONS}) WHERE "end" <= {_MARK}')
def stream_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from a stream: those that the watermark has closed; later ones wait for it."""
    import uuid

    e = streams.event_stream(spark, f"{sf_dir}/events.parquet*")
    s = rounded(streams.run_available(streams.sessions(e), f"sessions_{uuid.uuid4().hex[:8]}"), "value_sum", places=4)
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


# --- plain relational work


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""", relational=True)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""", relational=True)
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_custkey, o_orderkey, k::INTEGER AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3""", relational=True)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")


@query("""SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders""", relational=True)
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))
