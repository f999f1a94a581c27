"""Scoring and reporting: outcome beliefs, gated score, domain reports, judges and threshold calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions.text import bit_length_utf8

LABELS = ["novel_structure", "fluent_paraphrase", "clear_utility", "low_quality"]


def outcome_beliefs(rows: DataFrame, group: list[str], outcome: str, k: int) -> DataFrame:
    """(group..., prior, posterior): outcome shares overall and within the group, as arrays of k."""
    share = lambda: F.array(*[F.avg((F.col(outcome) == i).cast("double")) for i in range(k)])
    return rows.groupBy(*group).agg(share().alias("posterior")).crossJoin(F.broadcast(rows.agg(share().alias("prior"))))


def with_cue(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (prior, posterior, outcome, text) plus cue."""
    return rows.withColumn("cue", M.cue(M.brier_delta(F.col("prior"), F.col("posterior"), F.col("outcome")), bit_length_utf8(F.col(text))))


def with_score(rows: DataFrame, delta_d: float = 0.0, alpha: float = 1.0, lambda_g: float = 0.0) -> DataFrame:
    """``rows`` (cue, r_d, r_b, g_k) plus both gates and the score."""
    c = [F.coalesce(x, F.lit(0.0)) for x in ("cue", "r_d", "r_b", "g_k")]
    out = rows.withColumn("cue_gate", M.cue_gate(c[0])).withColumn("d_gate", M.novelty_gate(c[1], delta_d))
    return out.withColumn("score", M.gated_score(*c, delta_d=delta_d, alpha=alpha, lambda_g=lambda_g))


def report(rows: DataFrame) -> DataFrame:
    """One row: n, means, sample deviation, 95 % interval and pass rates. (m, m) for one row, NaN for none."""
    n, sd = F.count("*"), F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    half = F.when(n > 1, 1.96 * sd / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)
    nan = F.lit(float("nan"))
    low, high = F.when(n > 0, F.avg("score") - half).otherwise(nan), F.when(n > 0, F.avg("score") + half).otherwise(nan)
    return rows.agg(
        n.alias("n"), F.avg("score").alias("mean_score"), sd.alias("std_score"), low.alias("ci95_low"), high.alias("ci95_high"),
        F.avg("cue").alias("mean_cue"), F.avg("r_d").alias("mean_r_d"), F.avg("r_b").alias("mean_r_b"), F.avg(F.coalesce("g_k", F.lit(0.0))).alias("mean_g_k"),
        F.avg((F.col("cue_gate") > 0).cast("double")).alias("cue_gate_pass_rate"), F.avg((F.col("d_gate") > 0).cast("double")).alias("d_gate_pass_rate"),
        F.avg(((F.col("cue_gate") > 0) & (F.col("d_gate") > 0)).cast("double")).alias("gate_pass_rate"),
    )


def report_by_domain(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """n, mean score and pass rate of both gates by domain; null and empty domains are left out."""
    both = (F.col("cue_gate") > 0) & (F.col("d_gate") > 0)
    return rows.where(F.col(domain) != "").groupBy(domain).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(both.cast("double")).alias("gate_pass_rate"))


def judge_means(ratings: DataFrame, key: str = "response_id") -> DataFrame:
    """One row: mean of each criterion over responses, each the mean over its judges; ``overall`` is a response's mean
    over its criteria. ratings: (key, judge, criterion, rating); a response that no judge rated has no row."""
    per = ratings.where("rating is not null").groupBy(key, "criterion").agg(F.avg("rating").alias("m"))
    overall = per.groupBy(key).agg(F.avg("m").alias("m")).select(key, F.lit("overall").alias("criterion"), "m")
    return per.unionByName(overall).groupBy("criterion").agg(F.count("*").alias("n"), F.avg("m").alias("mean"))


def calibrate_delta(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row (for each group) from (kind, r_d), kind 'paraphrase' or 'restructure': the novelty threshold.

    Half-way where the smallest restructure exceeds the largest paraphrase; else the paraphrase at index
    int(0.9 (n - 1)) in ascending order, plus 0.001. That one is an exact discrete percentile, which is aggregated
    by value: no list of a group's values is made.
    """
    para, re_ = F.when(F.col("kind") == "paraphrase", F.col("r_d")), F.when(F.col("kind") == "restructure", F.col("r_d"))
    by = group or []
    values = scores.where((F.col("kind") == "paraphrase") & F.col("r_d").isNotNull()).groupBy(*by, "r_d").agg(F.count("*").alias("__n"))
    below = values.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("r_d")))
    n = values.groupBy(*by).agg(F.sum("__n").alias("__t")) if by else values.agg(F.sum("__n").alias("__t"))
    j = below.join(F.broadcast(n), by) if by else below.crossJoin(F.broadcast(n))
    nth = j.where(F.col("__upto") > F.floor(F.lit(0.9) * (F.col("__t") - 1))).groupBy(*by).agg(F.min("r_d").alias("__at"))
    a = scores.groupBy(*by).agg(F.max(para).alias("hi"), F.min(re_).alias("lo"), F.avg(para).alias("paraphrase_mean"), F.avg(re_).alias("restructure_mean"))
    a = a.join(nth, by, "left") if by else a.crossJoin(nth)
    apart = F.col("lo") > F.col("hi")
    return a.select(*by, apart.alias("separable"), F.when(apart, 0.5 * (F.col("hi") + F.col("lo"))).otherwise(F.col("__at") + 1e-3).alias("delta_d"), "paraphrase_mean", "restructure_mean")


def paraphrases(df: DataFrame, text: str = "text") -> DataFrame:
    """Three surface rewordings of each text: (columns..., variant, variant_text)."""
    t = F.col(text)
    minor = F.when(F.contains(t, F.lit("Propose")) | F.contains(t, F.lit("Write")), F.replace(F.replace(t, F.lit("Propose"), F.lit("Suggest")), F.lit("Write"), F.lit("Compose"))).otherwise(F.concat(F.lit("In short: "), t))
    variants = F.array(
        F.struct(F.lit("para_copy").alias("variant"), t.alias("variant_text")),
        F.struct(F.lit("para_minor").alias("variant"), minor.alias("variant_text")),
        F.struct(F.lit("para_wrap").alias("variant"), F.concat(F.lit("Here is the same request restated: "), t).alias("variant_text")),
    )
    return df.withColumn("__v", F.explode(variants)).select(*df.columns, "__v.variant", "__v.variant_text")


def resolve_delta(sidecar: DataFrame | None, default: float) -> float:
    row = sidecar.select("delta_d").first() if sidecar is not None else None
    return default if row is None or row[0] is None else float(row[0])
