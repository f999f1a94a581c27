"""Column functions on numbers: beliefs, gates, scores, entropies and curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def brier(beliefs: Column, outcome: Column) -> Column:
    """Sum of squared differences to the 0-based outcome."""
    return total(F.transform(beliefs, lambda x, i: F.pow(x - F.when(i == outcome, 1.0).otherwise(0.0), 2)))


def brier_delta(prior: Column, posterior: Column, outcome: Column) -> Column:
    return F.greatest(F.lit(0.0), brier(prior, outcome) - brier(posterior, outcome))


def cue(delta: Column, bits: Column) -> Column:
    """Decision-quality gain per bit; texts count 8 bits at least."""
    return delta / F.greatest(bits, F.lit(8.0))


def stub_cue(magnitude: Column, bits: Column) -> Column:
    """Plumbing only: opens the gate for every row."""
    return F.abs(magnitude) * 0.6931471805599453 / F.greatest(bits, F.lit(8.0))


def cue_gate(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def novelty_gate(x: Column, delta: Column | float) -> Column:
    return F.when(x > delta, 1.0).otherwise(0.0)


def effective_lambda(has_team: Column, lambda_g: Column | float, lambda_team: Column | float) -> Column:
    """0 without a team; the given weight if positive, else the team default."""
    given = F.lit(lambda_g) if not isinstance(lambda_g, Column) else lambda_g
    team = F.lit(lambda_team) if not isinstance(lambda_team, Column) else lambda_team
    return F.when(~has_team, 0.0).when(given > 0, given).otherwise(team)


def gated_score(cue_: Column, r_d: Column, r_b: Column, g_k: Column, delta_d=0.0, alpha=1.0, lambda_g=0.0) -> Column:
    return cue_gate(cue_) * novelty_gate(r_d, delta_d) * (cue_ * (1 + F.lit(alpha) * r_b) + F.lit(lambda_g) * g_k)


def shifted_score(cue_: Column, f: Column | float, r_d: Column, r_b: Column, g_k: Column, delta_d=0.0, alpha=1.0, lambda_g=0.0) -> Column:
    """The calibrated variant: cue less the threshold f in the gate and in the score."""
    return gated_score(cue_ - (f if isinstance(f, Column) else F.lit(f)), r_d, r_b, g_k, delta_d, alpha, lambda_g)


def utility_only(utility: Column, tau: Column | float) -> Column:
    """The baseline that knows no novelty: the utility where it is feasible."""
    return feasible_reward(utility, tau, utility)


def novelty_only(novelty: Column) -> Column:
    """The baseline that knows no feasibility: the novelty, whatever the utility."""
    return F.coalesce(novelty, F.lit(0.0))


def feasible_reward(utility: Column, tau: Column | float, reward: Column) -> Column:
    return F.when(utility >= tau, reward).otherwise(0.0)


def resolved(gap: Column, eps: Column | float) -> Column:
    """A true gap of over 2 eps keeps its rank under estimates within eps."""
    return gap > 2 * (eps if isinstance(eps, Column) else F.lit(eps))


def expansion_label(r_b: Column, delta: Column | float) -> Column:
    return F.when(r_b > delta, "expanding").when(r_b < delta, "clarifying").otherwise("neither")


def plogp(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def length_entropy(text: Column) -> Column:
    """ln(words + 1), one word at least: the stand-in where no embeddings are at hand."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.log(F.greatest(words, F.lit(1)) + 1.0)


def interaction_gain(joint: Column, agents: Column, clipped: bool = True) -> Column:
    """H(joint) - max H(agent); 0 without agents."""
    gain = joint - F.array_max(agents)
    gain = F.greatest(F.lit(0.0), gain) if clipped else gain
    return F.when(agents.isNull() | (F.size(agents) == 0) | joint.isNull(), 0.0).otherwise(gain)


def step_curve(t: Column, c_inf: Column, mu: Column, gamma: Column) -> Column:
    return c_inf * (1 - F.exp(-mu * t)) + gamma * t


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalized(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
