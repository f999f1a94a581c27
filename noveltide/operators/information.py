"""Information measures over finite distributions held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.functions.metrics import plogp


def pmf(rows: DataFrame, outcome: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., outcome..., n, p): shares within each group."""
    group = group or []
    c = rows.groupBy(*group, *outcome).agg(F.count("*").alias("n"))
    if group:
        return c.join(c.groupBy(*group).agg(F.sum("n").alias("__t")), group).withColumn("p", F.col("n") / F.col("__t")).drop("__t")
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("__t")))).withColumn("p", F.col("n") / F.col("__t")).drop("__t")


def entropy(rows: DataFrame, outcome: list[str], group: list[str] | None = None, name: str = "h") -> DataFrame:
    """(group..., h): plug-in entropy in nats."""
    p = pmf(rows, outcome, group)
    return p.groupBy(*(group or [])).agg(F.sum(plogp(F.col("p"))).alias(name)) if group else p.agg(F.sum(plogp(F.col("p"))).alias(name))


def entropy_with_bias(rows: DataFrame, outcome: list[str], group: list[str]) -> DataFrame:
    """(group..., n, support, h, bias_bound, h_normalized): the bias bound is support / (2 n)."""
    g = pmf(rows, outcome, group).groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("support"), F.sum(plogp(F.col("p"))).alias("h"))
    norm = F.when(F.col("support") > 1, F.col("h") / F.log(F.col("support").cast("double"))).otherwise(0.0)
    return g.withColumn("bias_bound", F.col("support") / (2.0 * F.col("n"))).withColumn("h_normalized", norm)


def kl(p: DataFrame, q: DataFrame, on: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., kl): sum of p ln(p / q) over p's support; null where q lacks a part of it. A column of ``on`` that is in
    ``group`` too conditions both sides, as the prompt does for a policy and its reference."""
    j = p.select(*dict.fromkeys([*(group or []), *on]), F.col("p").alias("__p")).join(q.select(*on, F.col("p").alias("__q")), on, "left").where(F.col("__p") > 0)
    part = F.when(F.coalesce("__q", F.lit(0.0)) > 0, F.col("__p") * F.log(F.col("__p") / F.col("__q")))
    out = F.when(F.count("*") == F.count(part), F.sum(part)).alias("kl")
    return j.groupBy(*group).agg(out) if group else j.agg(out)


def mixture(weights: DataFrame, kernel: DataFrame, on: str, outcome: str) -> DataFrame:
    """(outcome, p): sum over ``on`` of weight pi times kernel p."""
    return kernel.join(weights.select(on, "pi"), on).groupBy(outcome).agg(F.sum(F.col("pi") * F.col("p")).alias("p"))


def o_information3(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """One row: pair and triple entropies and H(ab) + H(ac) + H(bc) - H(abc), from one pass of counts of the triple."""
    triple = rows.groupBy(a, b, c).agg(F.count("*").alias("n"))
    total = triple.agg(F.sum("n").alias("t"))
    sets = {"h_ab": [a, b], "h_ac": [a, c], "h_bc": [b, c], "h_abc": [a, b, c]}
    out = None
    for name, keys in sets.items():
        h = triple.groupBy(*keys).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum(plogp(F.col("n") / F.col("t"))).alias(name))
        out = h if out is None else out.crossJoin(h)
    return out.withColumn("o_info", F.col("h_ab") + F.col("h_ac") + F.col("h_bc") - F.col("h_abc"))


def pair_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: H(a), H(b), H(ab), mutual information, and the unclipped gain H(ab) - max(H(a), H(b))."""
    pair = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    total, out = pair.agg(F.sum("n").alias("t")), None
    for name, keys in {"h_a": [a], "h_b": [b], "h_ab": [a, b]}.items():
        h = pair.groupBy(*keys).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum(plogp(F.col("n") / F.col("t"))).alias(name))
        out = h if out is None else out.crossJoin(h)
    return out.withColumn("mutual_info", F.col("h_a") + F.col("h_b") - F.col("h_ab")).withColumn("gain", F.col("h_ab") - F.greatest("h_a", "h_b"))


def product_kernel(rows: DataFrame, pairs: list[tuple[str, str]], eps: float = 1e-9) -> DataFrame:
    """(x, y, mutual_info, independent) for each pair of columns; a product kernel has none dependent."""
    out = None
    for a, b in pairs:
        r = pair_information(rows, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "mutual_info")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("independent", F.col("mutual_info") <= eps)


def joint_product(p: DataFrame, q: DataFrame) -> DataFrame:
    """The product of two small distributions (x, p) and (y, p)."""
    return p.select(F.col(p.columns[0]).alias("x"), F.col("p").alias("__p")).crossJoin(F.broadcast(q.select(F.col(q.columns[0]).alias("y"), F.col("p").alias("__q")))).select("x", "y", (F.col("__p") * F.col("__q")).alias("p"))


def tau_tight(models: DataFrame, tau: float) -> DataFrame:
    """One row: whether the entropy of every feasible incoherent baseline (u, h, coherent) is below tau."""
    m = models.where((F.col("u") >= tau) & ~F.col("coherent"))
    return m.agg(F.coalesce(F.max("h") < tau, F.lit(True)).alias("tight"))


def calibrated(rows: DataFrame, eps: float) -> DataFrame:
    """One row: whether |cue - h| stays within eps."""
    return rows.agg(F.max(F.abs(F.col("cue") - F.col("h"))).alias("worst")).withColumn("calibrated", F.coalesce(F.col("worst") <= eps, F.lit(True)))


def probe_gain(bits: DataFrame) -> DataFrame:
    """One row: the sum over probes of bits before less bits after."""
    return bits.agg(F.sum(F.col("bits_base") - F.col("bits_cond")).alias("gain"))
