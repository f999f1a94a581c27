"""n-gram models over idea symbols: counts, Witten-Bell probabilities and backoffs, bits, structural novelty.

The estimator divides a context's left-over mass by the lower-order mass of its *seen* continuations, so
probabilities of a context need not add up to 1; ``normalized=True`` divides by the mass of the unseen ones instead.

Model tables: ``p(n, ctx, w, p)`` and ``b(n, ctx, bow)``, contexts as symbols joined by blanks ('' for n = 1).
They are bounded by the symbol alphabet, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltide.session import materialize

BOS, EOS, UNK_P = "<s>", "</s>", 1e-99


def padded(symbols: DataFrame, key: str = "doc_id", begin: str = "") -> DataFrame:
    """(key, pos, w, c1, c2): each symbol and a final EOS, with the two before it: BOS before the first, ``begin`` before BOS.

    Training pads with two BOS (begin=BOS). Scoring starts from one BOS, so a first token's context is BOS alone.
    """
    w = Window.partitionBy(key).orderBy("pos")
    ends = symbols.groupBy(key).agg((F.max("pos") + 1).alias("pos")).select(key, "pos", F.lit(EOS).alias("sym"))
    s = symbols.select(key, "pos", "sym").unionByName(ends)
    return s.select(key, "pos", F.col("sym").alias("w"), F.coalesce(F.lag("sym", 1).over(w), F.lit(BOS)).alias("c1"), F.coalesce(F.lag("sym", 2).over(w), F.when(F.col("pos") == 0, begin).otherwise(BOS)).alias("c2"))


def counts(symbols: DataFrame, key: str = "doc_id") -> DataFrame:
    """(n, ctx, w, c) for n = 1 to 3, with the begin-of-sequence n-grams that a trigram model pads."""
    p = padded(symbols, key, BOS)
    grams = p.select(F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("").alias("ctx"), "w"),
        F.struct(F.lit(2).alias("n"), F.col("c1").alias("ctx"), "w"),
        F.struct(F.lit(3).alias("n"), F.concat_ws(" ", "c2", "c1").alias("ctx"), "w"),
    )).alias("g")).select("g.*")
    real = grams.groupBy("n", "ctx", "w").agg(F.count("*").alias("c"))
    pads = p.where(F.col("w") == EOS).agg(F.count("*").alias("k")).select(F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("").alias("ctx"), F.lit(BOS).alias("w"), (2 * F.col("k")).alias("c")),
        F.struct(F.lit(2).alias("n"), F.lit(BOS).alias("ctx"), F.lit(BOS).alias("w"), F.col("k").alias("c")),
    )).alias("g")).select("g.*").where("c > 0")
    return real.unionByName(pads)


def context_totals(c: DataFrame) -> DataFrame:
    """(n, ctx, total, kinds): occurrences and distinct continuations of each context."""
    return c.groupBy("n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))


def probabilities(c: DataFrame) -> DataFrame:
    """(n, ctx, w, p)."""
    one = c.where("n = 1")
    total = one.where(F.col("w") != BOS).agg(F.sum("c").alias("t"))
    uni = one.crossJoin(F.broadcast(total)).select("n", "ctx", "w", F.when(F.col("w") == BOS, UNK_P).otherwise(F.col("c") / F.col("t")).alias("p"))
    high = c.where("n > 1").join(context_totals(c), ["n", "ctx"]).select("n", "ctx", "w", (F.col("c") / (F.col("total") + F.col("kinds"))).alias("p"))
    return uni.unionByName(high)


def backoffs(c: DataFrame, p: DataFrame, normalized: bool = False) -> DataFrame:
    """(n, ctx, bow): the weight by which a context of n symbols backs off, n = 1 or 2."""
    low = p.select((F.col("n") + 1).alias("n"), F.col("ctx").alias("lctx"), "w", F.col("p").alias("lp"))
    shorter = F.when(F.col("n") == 2, F.lit("")).otherwise(F.substring_index("ctx", " ", -1))
    seen = c.where("n > 1").select("n", "ctx", "w", shorter.alias("lctx")).join(low, ["n", "lctx", "w"], "left")
    mass = seen.groupBy("n", "ctx").agg(F.sum(F.coalesce("lp", F.lit(0.0))).alias("mass"))
    left = F.col("kinds") / (F.col("total") + F.col("kinds"))
    rest = (1 - F.col("mass")) if normalized else F.col("mass")
    bow = F.when((rest <= 0) | (left <= 0), 1.0).otherwise(left / rest)
    return mass.join(context_totals(c), ["n", "ctx"]).select((F.col("n") - 1).alias("n"), "ctx", bow.alias("bow"))


def closed(p: DataFrame) -> DataFrame:
    """``p`` plus an entry of no mass for each context that is no n-gram of its own, as readers of back-off files expect."""
    contexts = p.where("n > 1").select((F.col("n") - 1).alias("n"), F.when(F.col("n") == 2, "").otherwise(F.substring_index("ctx", " ", 1)).alias("ctx"), F.substring_index("ctx", " ", -1).alias("w")).distinct()
    return p.unionByName(contexts.join(p, ["n", "ctx", "w"], "left_anti").withColumn("p", F.lit(UNK_P)))


def arpa_entries(p: DataFrame, b: DataFrame) -> DataFrame:
    """(n, gram, log10p, log10bow): the entries of an ARPA file; the longest n-grams have no back-off weight."""
    gram = F.trim(F.concat_ws(" ", "ctx", "w"))
    rows = closed(p).select("n", gram.alias("gram"), F.log10(F.greatest("p", F.lit(UNK_P))).alias("log10p"))
    bow = b.select("n", F.col("ctx").alias("gram"), F.log10(F.greatest("bow", F.lit(UNK_P))).alias("log10bow"))
    return rows.join(bow, ["n", "gram"], "left").withColumn("log10bow", F.when(F.col("n") < 3, F.coalesce("log10bow", F.lit(0.0))))


def token_bits(tokens: DataFrame, p: DataFrame, b: DataFrame) -> DataFrame:
    """``tokens`` (with w, c1, c2) plus bits: the longest n-gram known, times the backoffs passed on the way.

    Each distinct triple is scored once; their number is bounded by the alphabet, and tokens meet them in one join.
    The model's tables are joined as Spark sees fit: small ones are broadcast by their measured size.
    """
    p3 = p.where("n = 3").select(F.col("ctx").alias("__x2"), "w", F.col("p").alias("p3"))
    p2 = p.where("n = 2").select(F.col("ctx").alias("c1"), "w", F.col("p").alias("p2"))
    p1 = p.where("n = 1").select("w", F.col("p").alias("p1"))
    b2 = b.where("n = 2").select(F.col("ctx").alias("__x2"), F.col("bow").alias("b2"))
    b1 = b.where("n = 1").select(F.col("ctx").alias("c1"), F.col("bow").alias("b1"))
    t = tokens.select("w", "c1", "c2").distinct().withColumn("__x2", F.concat_ws(" ", "c2", "c1"))
    t = t.join(p3, ["__x2", "w"], "left").join(p2, ["c1", "w"], "left").join(p1, "w", "left").join(b2, "__x2", "left").join(b1, "c1", "left")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    prob = F.coalesce("p3", one("b2") * F.coalesce("p2", one("b1") * F.coalesce("p1", F.lit(UNK_P))))
    return tokens.join(t.select("w", "c1", "c2", (-F.log2(prob)).alias("bits")), ["w", "c1", "c2"]).select(*tokens.columns, "bits")


def sequence_bits(symbols: DataFrame, p: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bits) with the final EOS; keys without symbols are absent and count 0."""
    return token_bits(padded(symbols, key), p, b).groupBy(key).agg(F.sum("bits").alias("bits"))


def tails(symbols: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, t1, t2): the last symbol and the one before, BOS where there is none: the state a trigram model keeps."""
    last = symbols.groupBy(key).agg(F.max_by("sym", "pos").alias("t1"), F.max("pos").alias("top"))
    before = symbols.join(last.select(key, "top"), key).where(F.col("pos") == F.col("top") - 1).select(key, F.col("sym").alias("t2"))
    return last.select(key, "t1").join(before, key, "left").select(key, "t1", F.coalesce("t2", F.lit(BOS)).alias("t2"))


def array_tails(rows: DataFrame, key: str, syms: str) -> DataFrame:
    """The same from a column of symbol arrays, without a shuffle."""
    n = F.size(syms)
    return rows.where(n > 0).select(key, F.get(syms, n - 1).alias("t1"), F.coalesce(F.get(syms, n - 2), F.lit(BOS)).alias("t2"))


def novelty_by_tail(tail_rows: DataFrame, probes: DataFrame, p: DataFrame, b: DataFrame, probe_key: str = "item_id") -> DataFrame:
    """(t1, t2, r_d): bits of the probes alone less their bits after an output with this tail, summed over probes.

    Only a probe's first two tokens (its end included) see the output, so each distinct tail is scored once against
    the distinct pairs of first tokens, weighted by the number of probes that begin so.
    """
    heads = padded(probes, probe_key).where("pos < 2").groupBy(probe_key).agg(F.max(F.when(F.col("pos") == 0, F.col("w"))).alias("h1"), F.max(F.when(F.col("pos") == 1, F.col("w"))).alias("h2"))
    heads = heads.groupBy("h1", "h2").agg(F.count("*").alias("k"))
    states = tail_rows.select("t1", "t2").distinct().unionByName(tail_rows.sparkSession.createDataFrame([(BOS, "")], "t1 string, t2 string")).distinct()
    grid = states.crossJoin(F.broadcast(heads))  # both sides are bounded by the alphabet
    first = grid.select("t1", "t2", "k", F.col("h1").alias("w"), F.col("t1").alias("c1"), F.col("t2").alias("c2"))
    second = grid.where("h2 is not null").select("t1", "t2", "k", F.col("h2").alias("w"), F.col("h1").alias("c1"), F.col("t1").alias("c2"))
    bits = token_bits(first.unionByName(second), p, b).groupBy("t1", "t2").agg(F.sum(F.col("bits") * F.col("k")).alias("bits"))
    bits = materialize(bits, "tails")  # one row a state
    alone = bits.where(F.col("t1") == BOS).select(F.col("bits").alias("alone"))
    return bits.crossJoin(F.broadcast(alone)).select("t1", "t2", (F.col("alone") - F.col("bits")).alias("r_d"))


def structural_novelty(tail_rows: DataFrame, probes: DataFrame, p: DataFrame, b: DataFrame, key: str = "doc_id", probe_key: str = "item_id") -> DataFrame:
    """(key, r_d) from tails (key, t1, t2); an output without symbols has r_d 0 and no row here."""
    return tail_rows.join(novelty_by_tail(tail_rows, probes, p, b, probe_key), ["t1", "t2"]).select(key, "r_d")
