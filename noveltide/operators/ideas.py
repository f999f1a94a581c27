"""Idea operators: spans, hash embeddings, boundaries, codebooks, quantisation and soft-cluster entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.functions.metrics import dot, l2_normalized, sigmoid
from noveltide.functions.text import hash_bucket, hash_tokens, let, split_ideas


def exploded(df: DataFrame, columns: list, array: Column, at: str, item: str) -> DataFrame:
    """(columns..., at, item): the array's items. The outer form keeps Spark from computing the array a second time to
    filter by its size."""
    return df.select(*columns, F.posexplode_outer(array).alias(at, item)).where(F.col(item).isNotNull())


def explode_ideas(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, span), pos from 0; texts without ideas have no rows."""
    return exploded(df, [key], split_ideas(F.col(column)), "pos", "span")


def ngrams(xs: Column, n: int) -> Column:
    """Sliding n-grams of an array; [] if it is shorter than n."""
    if n <= 0:
        raise ValueError("n must be positive")
    empty = F.array_except(F.array(xs), F.array(xs))
    return F.when(F.size(xs) < n, empty).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - n + 1, F.lit(1))), lambda i: F.slice(xs, i, n)))


def hash_entries(df: DataFrame, key: list[str], column: str, dim: int = 64, hashes: int = 8) -> DataFrame:
    """(key, idx, val): non-zero entries of the unnormalised bag-of-hashes vector.

    Tokens are counted before they are hashed, so a frequent token is hashed once a row, not once an occurrence.
    """
    tokens = df.select(*key, F.explode(hash_tokens(F.col(column))).alias("tok")).groupBy(*key, "tok").agg(F.count("*").alias("n"))
    h = tokens.select(*key, "n", F.explode(F.array(*[F.sha2(F.concat(F.lit(f"{i}:"), "tok"), 256) for i in range(hashes)])).alias("h"))
    pieces = [F.substring("h", k, 2) for k in (7, 5, 3, 1)]  # little-endian
    idx = (F.conv(F.concat(*pieces), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return h.select(*key, idx.alias("idx"), (sign * F.col("n")).alias("s")).groupBy(*key, "idx").agg(F.sum("s").alias("val")).where("val <> 0")


def hash_encode(df: DataFrame, key: list[str], column: str, dim: int = 64, hashes: int = 8) -> DataFrame:
    """(key, idx, val): the unit vector's non-zero entries."""
    e = hash_entries(df, key, column, dim, hashes)
    return e.withColumn("val", F.col("val") / F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy(*key))))


def unit_vector(text: Column, dim: int = 64, hashes: int = 8) -> Column:
    """The vector of ``hash_encode`` as one array, made inside the row: no group of tokens has to be kept in memory. Null
    where all entries are 0."""
    sha = F.flatten(F.transform(hash_tokens(text), lambda t: F.array(*[F.sha2(F.concat(F.lit(f"{i}:"), t), 256) for i in range(hashes)])))
    low = (1,) if 256 % dim == 0 else (7, 5, 3, 1)  # the lowest byte alone decides where it can
    idx = lambda h: F.conv(F.concat(*[F.substring(h, k, 2) for k in low]), 16, 10).cast("long") % dim
    codes = F.transform(sha, lambda h: (idx(h) * 2 + F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2).cast("int"))
    rest = lambda xs, c: F.size(F.array_remove(xs, c.cast("int")))
    sums = let(codes, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (rest(xs, i * 2 + 1) - rest(xs, i * 2)).cast("double")))
    return let(sums, lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def last_vectors(spans: Column, dim: int = 64) -> Column:
    """Vectors of an array's items from its end on, until one that is there and the one before it are had: what
    ``lm.tails`` can ask for. Item i is that of position size - 1 - i."""
    none = F.lit(None).cast("array<array<double>>")
    done = lambda a: F.exists(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda v: v.isNotNull())
    return F.aggregate(F.reverse(spans), F.coalesce(none, F.array().cast("array<array<double>>")), lambda a, s: F.when(done(a), a).otherwise(F.concat(a, F.array(unit_vector(s, dim)))))


def dense(entries: DataFrame, key: list[str], dim: int) -> DataFrame:
    """(key, embedding): arrays of ``dim`` doubles."""
    m = entries.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    return m.select(*key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def boundary_probability(embedding: Column, weights: list[float], bias: float) -> Column:
    return sigmoid(dot(embedding, F.array(*[F.lit(float(x)) for x in weights])) + bias)


def merge_spans(spans: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, idea, text, embedding) from (key, pos, span, embedding, p): an idea ends after a span with p over the
    threshold; what follows the last such span is an idea too. Embeddings are averaged, texts joined by a blank."""
    w = Window.partitionBy(key).orderBy("pos")
    closed = F.coalesce(F.lag(F.when(F.col("p") > threshold, 1).otherwise(0)).over(w), F.lit(0))
    grouped = spans.withColumn("__c", closed).withColumn("idea", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    g = grouped.groupBy(key, "idea").agg(F.array_sort(F.collect_list(F.struct("pos", "span", "embedding"))).alias("s"))
    n = F.size("s")
    total = F.aggregate("s", F.transform(F.element_at("s", 1)["embedding"], lambda v: v * 0), lambda a, x: F.zip_with(a, x["embedding"], lambda p, q: p + q))
    return g.select(key, "idea", F.array_join(F.transform("s", lambda x: x["span"]), " ").alias("text"), F.transform(total, lambda v: v / n).alias("embedding"))


def mean_pool(vectors: DataFrame, key: list[str], column: str = "embedding") -> DataFrame:
    """(key, idx, val): the mean of each component; partial sums are made before the shuffle."""
    return vectors.select(*key, F.posexplode(column).alias("idx", "v")).groupBy(*key, "idx").agg(F.avg(F.col("v").cast("double")).alias("val"))


def centroids_by(vectors: DataFrame, label: str, column: str = "embedding") -> DataFrame:
    """(cid, centroid): normalised mean vector of each label."""
    m = mean_pool(vectors, [label], column).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("s"))
    return m.select(F.col(label).cast("int").alias("cid"), l2_normalized(F.transform("s", lambda x: x["val"])).alias("centroid"))


def train_codebook(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 25, column: str = "embedding") -> DataFrame:
    """(cid, centroid) by Lloyd's algorithm on the executors, normalised."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__v").fit(vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("__v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cid int, centroid array<double>").select("cid", l2_normalized(F.col("centroid")).alias("centroid"))


def as_codebook(centroids: DataFrame) -> DataFrame:
    """One row, one column: the codebook as an array of (cid, centroid), for a broadcast of fixed size."""
    return centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "centroid"))).alias("codebook"))


def quantize(vectors: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` plus cid and dist2 of the nearest centroid, the lowest cid among equals.

    The codebook is one row and joins by broadcast; the arg-min is taken inside the row, so no rows are multiplied.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    near = F.array_min(F.transform("codebook", lambda c: F.struct(F.aggregate(F.zip_with(v, c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("dist2"), c["cid"].alias("cid"))))
    return vectors.crossJoin(F.broadcast(as_codebook(centroids))).withColumn("__n", near).drop("codebook").withColumn("cid", F.col("__n.cid")).withColumn("dist2", F.col("__n.dist2")).drop("__n")


def soft_membership(v: Column, codebook: Column, temperature: float = 1.0) -> Column:
    """Softmax of -distance / T over the codebook."""
    d = F.transform(codebook, lambda c: F.sqrt(F.aggregate(F.zip_with(v, c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    # distances are shifted by the smallest, which leaves the softmax as it is
    shifted = let(d, lambda x: let(F.array_min(x), lambda low: F.transform(x, lambda y: F.exp((low - y) / max(temperature, 1e-8)))))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda t: F.transform(e, lambda y: y / t)))


def soft_entropy(samples: DataFrame, key: list[str], centroids: DataFrame, temperature: float = 1.0, column: str = "embedding") -> DataFrame:
    """(key, entropy): softmax of -distance / T for each sample, averaged over a key's samples, then entropy in nats."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = samples.crossJoin(F.broadcast(as_codebook(centroids)))
    mean = exploded(rows, key, soft_membership(v, F.col("codebook"), temperature), "c", "q").groupBy(*key, "c").agg(F.avg("q").alias("q"))
    return mean.groupBy(*key).agg((-F.sum(F.col("q") * F.log(F.col("q") + 1e-12))).alias("entropy"))


def normalized_expansion(entropies: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, r_b): mean entropy over tasks by ln K, within [0, 1]; 0 for one centroid."""
    top = F.lit(0.0) if k <= 1 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("entropy") / F.log(F.lit(float(k)))))
    return entropies.groupBy(*key).agg(top.alias("r_b"))


def symbol_array(text: Column, buckets: int = 32) -> Column:
    """The symbols of a text's spans, in order."""
    return F.transform(split_ideas(text), lambda s: F.concat(F.lit("i"), hash_bucket(F.lower(s), buckets).cast("string")))


def symbols(df: DataFrame, key: str = "doc_id", column: str = "text", buckets: int = 32) -> DataFrame:
    """(key, pos, sym): each span's symbol, by hash of its lower-cased text."""
    return exploded(df, [key], symbol_array(F.col(column), buckets), "pos", "sym")


def idea_symbols(df: DataFrame, key: str, column: str, centroids: DataFrame, weights: list[float] | None = None, bias: float = 0.0, threshold: float = 0.5, dim: int = 64, tail: bool = False) -> DataFrame:
    """(key, pos, sym): a text's ideas as codebook symbols. Spans are encoded in their rows, joined to ideas at the boundary
    detector's breaks (every span is an idea where there is none), and each idea is its nearest centroid's symbol, so
    rewordings that the encoder puts together share it. With ``tail`` only those symbols are made that ``lm.tails``
    reads; its result is the same. A detector needs all spans."""
    if tail and weights is None:
        rows = df.select(key, split_ideas(F.col(column)).alias("__s"))
        rows = exploded(rows, [key, F.size("__s").alias("__n")], last_vectors(F.col("__s"), dim), "__i", "embedding")
        found = rows.select(key, (F.col("__n") - 1 - F.col("__i")).alias("idea"), "embedding")
    else:
        rows = exploded(explode_ideas(df, key, column), [key, "pos", "span"], F.array(unit_vector(F.col("span"), dim)), "__i", "embedding")
        found = rows.select(key, F.col("pos").alias("idea"), "embedding") if weights is None else merge_spans(rows.withColumn("p", boundary_probability(F.col("embedding"), weights, bias)), key, threshold)
    return quantize(found, centroids).select(key, F.col("idea").cast("int").alias("pos"), F.concat(F.lit("c"), F.col("cid").cast("string")).alias("sym"))
