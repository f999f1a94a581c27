"""Composed plans: outputs with symbols, a model, beliefs and the gated score, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.functions.text import clip, let, split_ideas
from noveltide.operators import ideas, lm, scores
from noveltide.session import materialize

from .tables import table

BUCKETS = 32


@dataclass(frozen=True)
class Model:
    """A trained trigram model: its tables are bounded by the alphabet (BUCKETS symbols), whatever the corpus."""

    p: DataFrame
    b: DataFrame

    def save(self, path: str) -> None:
        self.p.coalesce(1).write.mode("overwrite").parquet(f"{path}/p")
        self.b.coalesce(1).write.mode("overwrite").parquet(f"{path}/b")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        return Model(spark.read.parquet(f"{path}/p"), spark.read.parquet(f"{path}/b"))


def train(symbols: DataFrame, key: str = "doc_id") -> Model:
    c = materialize(lm.counts(symbols, key).coalesce(1), "ngrams")
    p = materialize(lm.probabilities(c).coalesce(1), "probabilities")
    return Model(p, materialize(lm.backoffs(c, p).coalesce(1), "backoffs"))


def outcome(quality, toxic):
    """Novel structure for good texts, low quality for toxic ones, clear utility for good and toxic, paraphrase for the rest."""
    return F.when((quality == 1) & (toxic == 0), 0).when((quality == 0) & (toxic == 0), 1).when((quality == 1) & (toxic == 1), 2).otherwise(3)


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with prior, posterior by (lang, source) and outcome."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("outcome", outcome(F.col("quality"), F.col("toxic")))
    by = scores.outcome_beliefs(rows, ["lang", "source"], "outcome", 4)
    return rows.join(by, ["lang", "source"])


def symbol_expansion(rows: DataFrame, key: str = "doc_id", syms: str = "syms", k: int = BUCKETS) -> DataFrame:
    """(key, r_b): entropy of a text's idea symbols by ln k, within [0, 1], from H = ln t - (sum of n ln n) / t."""
    n = rows.select(key, F.explode(syms).alias("sym")).groupBy(key, "sym").agg(F.count("*").alias("n"))
    t = F.sum("n")
    h = n.groupBy(key).agg((F.log(t) - F.sum(F.col("n") * F.log("n")) / t).alias("h"))
    return h.select(key, F.least(F.lit(1.0), F.col("h") / F.log(F.lit(float(k)))).alias("r_b"))


def probe_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    """The frozen probes' symbols and the model trained on them."""
    probes = materialize(ideas.symbols(table(spark, sf_dir, "benchmark"), "item_id", buckets=BUCKETS), "probes")
    return probes, train(probes, "item_id")


def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, syms): every text split and hashed once, and written, since several branches read it."""
    return materialize(table(spark, sf_dir, "documents").select("doc_id", ideas.symbol_array(F.col("text"), BUCKETS).alias("syms")), "symbols")


def document_novelty(spark: SparkSession, sf_dir: str, syms: DataFrame | None = None) -> DataFrame:
    """(doc_id, r_d) against the frozen probes."""
    probes, model = probe_model(spark, sf_dir)
    syms = document_symbols(spark, sf_dir) if syms is None else syms
    return lm.structural_novelty(lm.array_tails(syms, "doc_id", "syms"), probes, model.p, model.b)


def scored_documents(spark: SparkSession, sf_dir: str, delta_d: float = 0.0, alpha: float = 1.0) -> DataFrame:
    """Labelled documents with cue, r_d, r_b, g_k, gates and score; domain is the language."""
    syms = document_symbols(spark, sf_dir)
    r_d, r_b = document_novelty(spark, sf_dir, syms), symbol_expansion(syms)
    rows = scores.with_cue(beliefs(spark, sf_dir)).select("doc_id", F.col("lang").alias("domain"), "cue")
    rows = rows.join(r_d, "doc_id", "left").join(r_b, "doc_id", "left")
    rows = rows.select("doc_id", "domain", "cue", F.round(F.coalesce("r_d", F.lit(0.0)), 9).alias("r_d"), F.coalesce("r_b", F.lit(0.0)).alias("r_b"), F.lit(0.0).alias("g_k"))
    return scores.with_score(rows, delta_d, alpha)


def battery(spark: SparkSession) -> DataFrame:
    """A task battery of our own: (id, domain, input)."""
    rows = [
        ("t1", "writing", "Continue in two sentences a story about a lighthouse that forgets its sailors."),
        ("t2", "science", "Name three things to measure in a study of moss on city walls."),
        ("t3", "proof", "State the next step after showing that a sum of two even numbers is even."),
        ("t4", "writing", "Invent a custom for a town that trades in echoes."),
    ]
    return spark.createDataFrame(rows, "id string, domain string, input string")


def receiver_samples(context: Column, task: Column, n: int) -> Column:
    """Spans of the deterministic receiver's samples, an array for each of n variants. Only the first 400 stripped
    characters of an output are its context."""

    def sample(v: Column) -> Column:
        v = v.cast("string")
        return split_ideas(F.concat(F.lit("Context:\n"), context, F.lit("\n\nTask:\n"), F.trim(task), F.lit("\n\nVariant-"), v, F.lit(": focus angle "), v, F.lit(".")))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)


#: Receivers by name: (context, task's input, n) -> arrays of spans. Encoders by name: (span, dim) -> embedding or null.
RECEIVERS: dict[str, Callable[..., Column]] = {"hash": receiver_samples}
ENCODERS: dict[str, Callable[..., Column]] = {"hash": ideas.unit_vector}


def chosen(registry: dict[str, Callable[..., Column]], name: str) -> Callable[..., Column]:
    if name not in registry:
        raise ValueError(f"{name!r} is not registered; there are {sorted(registry)}")
    return registry[name]


def receiver_expansion(outputs: DataFrame, tasks: DataFrame, centroids: DataFrame, k: int, key: str, n: int = 4, dim: int = 64, temperature: float = 1.0, receiver: str = "hash", encoder: str = "hash") -> DataFrame:
    """(key, r_b): as ``soft_entropy`` and ``normalized_expansion`` over samples, but inside a key's row, so that a task holds
    no more than one key at a time. Each distinct span of an output is encoded once; outputs of one key share samples."""
    samples, encode = chosen(RECEIVERS, receiver), chosen(ENCODERS, encoder)
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    zeros, start = F.array_repeat(F.lit(0.0), dim), F.struct(F.array_repeat(F.lit(0.0), dim).alias("s"), F.lit(0).alias("n"))
    plus = lambda a, b: F.struct(add(a["s"], b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))

    def sums(spans: Column, vectors: Column) -> Column:
        there = F.filter(F.transform(spans, lambda x: F.try_element_at(vectors, x)), lambda v: v.isNotNull())
        return let(there, lambda vs: F.struct(F.aggregate(vs, zeros, add).alias("s"), F.size(vs).alias("n")))

    def one(ctx: Column) -> Column:
        found = F.transform("battery", lambda t: samples(ctx, t["input"], n))
        coded = lambda g: let(F.array_distinct(F.flatten(F.flatten(g))), lambda u: F.map_from_arrays(u, F.transform(u, lambda x: encode(x, dim))))
        return let(found, lambda g: let(coded(g), lambda m: F.flatten(F.transform(g, lambda by: F.transform(by, lambda spans: sums(spans, m))))))

    # few bytes hold much work: the keys are dealt to all cores rather than by their size
    parts = 4 * outputs.sparkSession.sparkContext.defaultParallelism
    rows = outputs.select(key, clip(F.col("text"), 400).alias("ctx")).repartition(parts, key).groupBy(key).agg(F.array_sort(F.collect_list("ctx")).alias("ctxs"))
    battery = tasks.agg(F.array_sort(F.collect_list(F.struct("id", "input"))).alias("battery"))
    rows = rows.crossJoin(F.broadcast(battery)).crossJoin(F.broadcast(ideas.as_codebook(centroids)))
    empty = F.transform(F.sequence(F.lit(1), F.size("battery") * n), lambda i: start)
    merged = F.aggregate(F.transform("ctxs", one), empty, lambda a, x: F.zip_with(a, x, plus))

    def entropy(group: Column) -> Column:
        p = F.transform(F.filter(group, lambda x: x["n"] > 0), lambda x: ideas.soft_membership(F.transform(x["s"], lambda v: v / x["n"]), F.col("codebook"), temperature))
        mean = let(p, lambda ps: F.when(F.size(ps) > 0, F.transform(F.aggregate(ps, F.array_repeat(F.lit(0.0), F.size("codebook")), add), lambda q: q / F.size(ps))))
        return let(mean, lambda qs: F.when(qs.isNotNull(), -F.aggregate(qs, F.lit(0.0), lambda a, q: a + q * F.log(q + 1e-12))))

    by_task = let(merged, lambda m: F.transform(F.sequence(F.lit(0), F.size("battery") - 1), lambda i: entropy(F.slice(m, i * n + 1, n))))
    mean = let(F.filter(by_task, lambda h: h.isNotNull()), lambda hs: F.when(F.size(hs) > 0, F.aggregate(hs, F.lit(0.0), lambda a, h: a + h) / F.size(hs)))
    top = F.lit(0.0) if k <= 1 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("h") / F.log(F.lit(float(k)))))
    return ideas.exploded(rows, [key], F.array(mean), "i", "h").select(key, top.alias("r_b"))
