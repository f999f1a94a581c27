"""Revision trajectories: diverge-converge shape, step rewards and the step-gain curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diverge_converge(points: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, n_points, dc, peak_index): dc is 1 for at least three values that rise strictly to an inner peak and then fall
    strictly; ties give 0. peak_index counts from 0 and is null without a peak."""
    d = points.withColumn("__d", F.signum(F.lead(value).over(Window.partitionBy(key).orderBy("t")) - F.col(value)))
    d = d.withColumn("__s", F.lead("__d").over(Window.partitionBy(key).orderBy("t")))
    g = d.groupBy(key).agg(
        F.count("*").alias("n_points"),
        F.min_by("__d", "t").alias("first"),
        F.count(F.when(F.col("__d") == 0, 1)).alias("flat"),
        F.count(F.when(F.col("__d") > 0, 1)).alias("up"),
        F.count(F.when(F.col("__d") < 0, 1)).alias("down"),
        F.count(F.when((F.col("__d") * F.col("__s")) < 0, 1)).alias("turns"),
    )
    ok = (F.col("n_points") >= 3) & (F.col("first") > 0) & (F.col("flat") == 0) & (F.col("down") > 0) & (F.col("turns") == 1)
    ok = F.coalesce(ok, F.lit(False))
    return g.select(key, "n_points", F.when(ok, 1.0).otherwise(0.0).alias("dc"), F.when(ok, F.col("up")).cast("int").alias("peak_index"))


def step_rewards(points: DataFrame, key: str, value: str = "v", bonus: float = 0.0) -> DataFrame:
    """(key, t, reward, total): each step's gain and the running sum plus a bonus."""
    w = Window.partitionBy(key).orderBy("t")
    r = points.withColumn("reward", F.lead(value).over(w) - F.col(value)).where("reward is not null")
    return r.select(key, "t", "reward", (F.sum("reward").over(w.rowsBetween(Window.unboundedPreceding, 0)) + bonus).alias("total"))


def fit_curve(t: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float, float, float]:
    """Least-squares c (1 - exp(-mu t)) + gamma t by damped Gauss-Newton steps from (last value or 1, 0.5, 0); (c, mu, gamma, rmse).

    c and gamma enter linearly, so each trial of mu solves for both exactly (variable projection); damping acts on mu.
    A mu at which the curve overflows is refused; the values are not finite only where no curve can be had at all.
    """
    t, y = np.asarray(t, float), np.asarray(y, float)

    def solve(mu: float) -> tuple[np.ndarray, float]:
        a = np.stack([1 - np.exp(-mu * t), t], 1)
        if not np.isfinite(a).all():  # exp overflows: no curve, and a trial that is worse than any
            return np.full(2, np.nan), np.inf
        try:
            p = np.linalg.lstsq(a, y, rcond=None)[0]
        except np.linalg.LinAlgError:
            return np.full(2, np.nan), np.inf
        return p, float(((a @ p - y) ** 2).sum())

    mu, best = 0.5, solve(0.5)
    for start in (0.5, 0.05, 2.0, 8.0):
        m, lam = start, 1e-3
        p, sse = solve(m)
        slope = None
        for _ in range(steps):
            if slope is None:  # a refused step leaves it as it was
                h = max(1e-6, 1e-4 * abs(m))
                up, down = solve(m + h)[1], solve(m - h)[1]
                slope, bend = (up - down) / (2 * h), (up - 2 * sse + down) / (h * h)
            step = -slope / (abs(bend) + lam)
            if not np.isfinite(step) or abs(step) < 1e-12 * max(1, abs(m)):
                break
            q, new = solve(m + step)
            if new < sse:
                m, p, sse, lam, slope = m + step, q, new, max(lam / 4, 1e-12), None
            else:
                lam = max(lam, 1e-9) * 8
                if lam > 1e12:
                    break
        if sse < best[1] - 1e-15:
            mu, best = m, (p, sse)
    return float(best[0][0]), float(mu), float(best[0][1]), float(np.sqrt(best[1] / len(t)))


CURVE = "n_points int, c_inf double, mu double, gamma double, residual_rmse double, reliable boolean"


def step_cue_fit(points: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, curve...): nulls below three points and where there is no fit, else reliable from four. A key is one transcript,
    so a group is small. Few bytes hold much work, so the groups are dealt to all cores rather than by their size."""
    kind = dict(points.dtypes)[key]
    points = points.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, key)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.dropna(subset=[value]).sort_values("t")
        with np.errstate(over="ignore", invalid="ignore"):
            fit = fit_curve(x["t"].to_numpy(), x[value].to_numpy()) if len(x) >= 3 else (np.nan,)
        row = [len(x), *fit, len(x) >= 4] if np.isfinite(fit).all() else [len(x), None, None, None, None, False]
        return pd.DataFrame([row], columns=[c.split()[0] for c in CURVE.split(", ")])

    return points.groupBy(key).applyInPandas(lambda k, x: run(x).assign(**{key: k[0]})[[key, *[c.split()[0] for c in CURVE.split(", ")]]], f"{key} {kind}, {CURVE}")
