"""Training-signal operators: group advantages, preference pairs, frontiers, monitors and protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(rows: DataFrame, group: str, reward: str, eps: float = 1e-8) -> DataFrame:
    """``rows`` plus advantage: (r - mean) / (population deviation + eps) within the group.

    The group's moments come from a partial aggregate and a join, so a hot group is not sorted into one task.
    """
    m = rows.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"))
    gain = F.when(F.col("__s") > 0, (F.col(reward) - F.col("__m")) / (F.col("__s") + eps)).when(F.col(reward).isNotNull(), 0.0)
    return rows.join(m, group).withColumn("advantage", gain).drop("__m", "__s")


def two_rollout_advantage(rows: DataFrame, group: str, order: str, reward: str) -> DataFrame:
    """(group, r1, r2, a1, a2) of each group's first two rollouts: +-1/sqrt 2, or 0 where equal."""
    w = Window.partitionBy(group).orderBy(order)
    two = rows.withColumn("__k", F.row_number().over(w)).where("__k <= 2").groupBy(group).agg(F.max(F.when(F.col("__k") == 1, F.col(reward))).alias("r1"), F.max(F.when(F.col("__k") == 2, F.col(reward))).alias("r2"))
    sign = F.signum(F.col("r1") - F.col("r2")) / F.sqrt(F.lit(2.0))
    return two.where("r1 is not null and r2 is not null").withColumn("a1", sign).withColumn("a2", -sign)


def valid_pairs(rows: DataFrame, group: str, key: str, reward: str, eps: float) -> DataFrame:
    """(group, winner, loser, gap): pairs of one group whose rewards differ by over 2 eps.

    The pairs are the result, so groups are rollouts of one prompt; ``pair_counts`` counts them in groups of any size.
    """
    r = rows.select(group, F.col(key).alias("winner"), F.col(reward).alias("rw"))
    s = rows.select(group, F.col(key).alias("loser"), F.col(reward).alias("rl"))
    return r.join(s, group).where(F.col("rw") > F.col("rl") + 2 * eps).select(group, "winner", "loser", (F.col("rw") - F.col("rl")).alias("gap"))


def pair_counts(rows: DataFrame, group: str, reward: str, eps: float) -> DataFrame:
    """(group, n_pairs): how many valid pairs each group has, by a range count over its sorted rewards, listing none."""
    over = f"count(`{reward}`) OVER (PARTITION BY `{group}` ORDER BY `{reward}` RANGE BETWEEN {{}} AND {2 * eps!r}D PRECEDING)"
    c = rows.withColumn("__n", F.expr(over.format("UNBOUNDED PRECEDING")) - F.expr(over.format(f"{2 * eps!r}D PRECEDING")))
    return c.groupBy(group).agg(F.sum("__n").alias("n_pairs"))


def net_wins(rows: DataFrame, group: str, reward: str, eps: float) -> DataFrame:
    """``rows`` plus net: the valid pairs a row wins less those it loses, by range counts over its group's sorted rewards."""
    own = f"PARTITION BY `{group}` ORDER BY `{reward}` RANGE BETWEEN"
    wins = f"count(`{reward}`) OVER ({own} UNBOUNDED PRECEDING AND CURRENT ROW) - count(`{reward}`) OVER ({own} {2 * eps!r}D PRECEDING AND CURRENT ROW)"
    losses = f"count(`{reward}`) OVER ({own} CURRENT ROW AND UNBOUNDED FOLLOWING) - count(`{reward}`) OVER ({own} CURRENT ROW AND {2 * eps!r}D FOLLOWING)"
    return rows.withColumn("net", F.expr(f"case when `{reward}` is null then 0 else ({wins}) - ({losses}) end"))


def rank_reversals(rows: DataFrame, group: str, truth: str, proxy: str) -> DataFrame:
    """(group, n_pairs, n_reversed, concordance): ordered pairs by truth, and those the proxy orders the other way.

    Values are tallied per group first, so copies of a value pair are one row in the join.
    """
    t = rows.groupBy(group, truth, proxy).agg(F.count("*").alias("k"))
    a = t.select(group, F.col(truth).alias("t1"), F.col(proxy).alias("p1"), F.col("k").alias("k1"))
    b = t.select(group, F.col(truth).alias("t2"), F.col(proxy).alias("p2"), F.col("k").alias("k2"))
    j = a.join(b, group).where("t1 > t2")
    n = F.col("k1") * F.col("k2")
    g = j.groupBy(group).agg(F.sum(n).alias("n_pairs"), F.sum(F.when(F.col("p1") < F.col("p2"), n).otherwise(0)).alias("n_reversed"))
    return g.withColumn("concordance", 1 - F.col("n_reversed") / F.col("n_pairs"))


def pareto_frontier(rows: DataFrame, b: str, d: str, group: str | None = None) -> DataFrame:
    """Rows that no other beats: none with a larger b has as large a d. A running maximum, not a self-join."""
    g = [group] if group else [F.lit(1)]
    best = rows.groupBy(*([group] if group else []), b).agg(F.max(d).alias("__d"))
    w = Window.partitionBy(*g).orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("__above", F.max("__d").over(w)).drop("__d")
    keys = [group, b] if group else [b]
    return rows.join(best, keys).where(F.col("__above").isNull() | (F.col(d) > F.col("__above"))).drop("__above")


def proxy_monitor(rows: DataFrame, checkpoint: str, proxy: str, bench: str, least: float) -> DataFrame:
    """(checkpoint, n, rho, ok): correlation of proxy and benchmark rewards, and whether it reaches ``least``."""
    g = rows.groupBy(checkpoint).agg(F.count("*").alias("n"), F.corr(proxy, bench).alias("rho"))
    return g.withColumn("ok", F.coalesce(F.col("rho") >= least, F.lit(False)))


def lambda_d(rows: DataFrame, outcome: str, probes: int, alphabet: str, length: str) -> DataFrame:
    """One row: ln |Z| / (P ln |Sigma| E|s|), the factor that brings structural novelty to the scale of expansion."""
    a = rows.agg(F.countDistinct(outcome).alias("z"), F.countDistinct(alphabet).alias("sigma"), F.avg(length).alias("mean_length"))
    return a.withColumn("lambda_d", F.log(F.col("z").cast("double")) / (probes * F.log(F.col("sigma").cast("double")) * F.col("mean_length")))


def benchmark_reward(r_b: Column, r_d: Column, lam: Column | float) -> Column:
    return r_b + (lam if isinstance(lam, Column) else F.lit(lam)) * r_d


def softmax_policy(rows: DataFrame, group: str, logit: str) -> DataFrame:
    """``rows`` plus pi: softmax of the logits within the group, shifted by their maximum."""
    m = rows.groupBy(group).agg(F.max(logit).alias("__m"))
    e = rows.join(m, group).withColumn("__e", F.exp(F.col(logit) - F.col("__m"))).drop("__m")
    return e.join(e.groupBy(group).agg(F.sum("__e").alias("__t")), group).withColumn("pi", F.col("__e") / F.col("__t")).drop("__e", "__t")


def expected_reward(policy: DataFrame, group: str, reward: str) -> DataFrame:
    return policy.groupBy(group).agg(F.sum(F.col("pi") * F.col(reward)).alias("expected_reward"))


def logit_update(policy: DataFrame, group: str, reward: str, eps: float, logit: str, step: float) -> DataFrame:
    """Logits after each valid pair of a group adds ``step`` to its winner and takes it from its loser; no pair is listed."""
    return net_wins(policy, group, reward, eps).withColumn(logit, F.col(logit) + step * F.col("net")).drop("net")


def dpo_log_odds(pi_w: Column, pi_l: Column, ref_w: Column, ref_l: Column, beta: float) -> Column:
    return beta * (F.log(pi_w / ref_w) - F.log(pi_l / ref_l))


def probes_rotate(batches: DataFrame, probe: str, step: str) -> DataFrame:
    """One row: whether no probe is in every batch."""
    n = batches.agg(F.countDistinct(step).alias("n"))
    g = batches.groupBy(probe).agg(F.countDistinct(step).alias("k")).crossJoin(F.broadcast(n))
    return g.agg(F.coalesce(F.max(F.col("k") == F.col("n")), F.lit(False)).alias("stuck")).select((~F.col("stuck")).alias("rotates"))


def groupthink(rows: DataFrame, gain: str, milestone: str, least: float = 0.7) -> DataFrame:
    return rows.where((F.col(gain) < 0) & (F.col(milestone) < least))


def dominates(episodes: DataFrame, key: str, topology: str, gain: str, eps: str, better: str, worse: str) -> DataFrame:
    """(key, dominates): whether the better topology's gain exceeds the worse's by over twice the worse's estimator error.
    Keys without an episode of both have no row; of several episodes the first by gain stands."""
    side = lambda t, a: episodes.where(F.col(topology) == t).groupBy(key).agg(F.min(F.struct(gain, eps)).alias(a))
    j = side(better, "b").join(side(worse, "w"), key)
    return j.select(key, (F.col(f"w.{gain}") + 2 * F.col(f"w.{eps}") < F.col(f"b.{gain}")).alias("dominates"))


def follows_schedule(corpus: DataFrame, schedule: DataFrame, step: str, item: str) -> DataFrame:
    """One row: whether the corpus of every step holds the scheduled items, each as often."""
    n = lambda df, sign: df.select(step, item, F.lit(sign).alias("__n"))
    differ = n(corpus, 1).union(n(schedule, -1)).groupBy(step, item).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return differ.limit(1).agg((F.count("*") == 0).alias("follows"))


def contained(outputs: DataFrame, corpus: DataFrame, key: str, symbols: str) -> DataFrame:
    """``outputs`` (key, symbols) plus contained: whether its symbols occur in a row in any corpus row.

    Corpus rows are cut into windows as long as the shortest output; windows meet outputs by the hash of their first
    symbols, and the whole run is compared where they do. An output without symbols is contained in everything.
    """
    shortest = outputs.where(F.size(symbols) > 0).agg(F.min(F.size(symbols))).first()[0] or 1
    o = outputs.where(F.size(symbols) > 0).select(F.xxhash64(F.slice(symbols, 1, shortest)).alias("__h"), F.col(key).alias("__k"), F.col(symbols).alias("__o")).distinct()
    starts = F.explode(F.sequence(F.lit(1), F.size(symbols) - shortest + 1)).alias("__i")
    c = corpus.where(F.size(symbols) >= shortest).select(F.col(symbols).alias("__c"), starts).withColumn("__h", F.xxhash64(F.slice("__c", F.col("__i"), F.lit(shortest))))
    hit = c.join(o, "__h").where(F.slice("__c", F.col("__i"), F.size("__o")) == F.col("__o")).select(F.col("__k").alias(key)).distinct()
    return outputs.join(hit.withColumn("__f", F.lit(True)), key, "left").withColumn("contained", F.coalesce("__f", F.size(symbols) == 0)).drop("__f")


def live_reward(live: DataFrame, reward: Column) -> DataFrame:
    """``live`` plus reward. The frozen tables are no argument, so the reward cannot depend on them."""
    return live.withColumn("reward", reward)
