"""Scoring: Fellegi-Sunter weights learned by expectation maximisation over the histogram of agreement patterns.

A pair takes part only through its levels, so one Spark aggregation to the distinct patterns with counts is a sufficient statistic: there
are at most 5^fields of them however many pairs. Iterations run in numpy over patterns, and scoring joins nothing: weights are literals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AUTO_MATCH, AUTO_REJECT, BORDERLINE, NULL, EmptySchema, ModelParams, NotFitted
from ..storage import forget, stored

# Start and default probabilities of the levels none, partial, close, exact.
M_PRIOR, U_PRIOR, M_DEFAULT = [0.02, 0.06, 0.12, 0.80], [0.70, 0.15, 0.10, 0.05], [0.01, 0.04, 0.10, 0.85]
FLOOR, BELOW = 1e-9, 1 - 1e-12
# Pairs added to each level, and the thresholds that go with them.
SMOOTHING, SMOOTHED_THRESHOLDS = 1e-3, (0.9, 0.1)
#: Patterns up to this number go to the driver; beyond it the iterations run as Spark aggregations.
MAX_PATTERNS = 500_000


def default_params(n_fields: int) -> ModelParams:
    """For no pairs at all, and for streams."""
    return ModelParams([M_DEFAULT[:] for _ in range(n_fields)], [U_PRIOR[:] for _ in range(n_fields)], -2.0, 0.85, 0.15)


def initial_params(n_fields: int, share: float) -> ModelParams:
    return ModelParams([M_PRIOR[:] for _ in range(n_fields)], [U_PRIOR[:] for _ in range(n_fields)], math.log(share / (1 - share)))


def indifferent_params(n_fields: int) -> ModelParams:
    """Where iterations over no pairs at all settle, after two: every level is as likely for matches as for others."""
    return ModelParams([[0.25] * 4 for _ in range(n_fields)], [[0.25] * 4 for _ in range(n_fields)], math.log(0.999 / 0.001))


def patterns(compared: DataFrame, levels: list[str]) -> DataFrame:
    """The distinct level vectors and their numbers of pairs."""
    return compared.groupBy(*levels).agg(F.count("*").alias("n"))


def estimate_lambda(compared: DataFrame, levels: list[str]) -> DataFrame:
    """One row: the share of pairs with an exact field, within 0.001 and 0.5; 0.01 for no pairs."""
    exact = F.greatest(F.lit(0), *((F.col(c) == 3).cast("int") for c in levels))
    return compared.agg(F.coalesce(F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.avg(exact))), F.lit(0.01)).alias("lambda"))


def log_weights(p: ModelParams) -> np.ndarray:
    return np.log(np.maximum(p.m, FLOOR)) - np.log(np.maximum(p.u, FLOOR))


def probabilities(x: np.ndarray, p: ModelParams) -> np.ndarray:
    """The match probability of each pattern (rows of levels)."""
    w = np.concatenate([log_weights(p), np.zeros((x.shape[1], 1))], 1)
    z = p.log_prior_odds + w[np.arange(x.shape[1]), np.where(x == NULL, 4, x)].sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def m_step(x: np.ndarray, n: np.ndarray, prob: np.ndarray, old: ModelParams, smoothing: float = 0.0) -> ModelParams:
    """New parameters from the patterns' match probabilities. smoothing: pairs added to each level's count, over all pairs of its class."""

    def shares(weight: np.ndarray) -> list[list[float]]:
        out = []
        for f in range(x.shape[1]):
            c = np.array([weight[x[:, f] == v].sum() for v in range(4)])
            if smoothing:
                out.append(((c + smoothing) / max(weight.sum() + 4 * smoothing, FLOOR)).tolist())
                continue
            total = c.sum()
            c = np.maximum(c / total if total > 0 else np.full(4, 0.25), FLOOR)
            out.append((c / c.sum()).tolist())
        return out

    share = min(max(float((prob * n).sum() / n.sum()), 0.001), 0.999)
    return ModelParams(shares(prob * n), shares((1 - prob) * n), math.log(share / (1 - share)), old.upper_threshold, old.lower_threshold)


def change(a: ModelParams, b: ModelParams) -> float:
    return float(max(np.abs(np.subtract(a.m, b.m)).max(), np.abs(np.subtract(a.u, b.u)).max(), abs(a.log_prior_odds - b.log_prior_odds)))


def calibrated(prob: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Thresholds from the scores: the lowest 5 % of the high ones, the highest 5 % of the low ones."""

    def ranked(keep: np.ndarray, q: float) -> float | None:
        p, c = prob[keep], n[keep]
        if c.sum() < 10:
            return None
        order = np.argsort(p, kind="stable")
        return float(p[order][np.searchsorted(np.cumsum(c[order]), math.floor(q * c.sum()), side="right")])

    # a little less than the scores they come from, so that another way of computing the same score can't fall below
    high, low = ranked(prob >= 0.7, 0.05), ranked(prob <= 0.3, 0.95)
    return (0.9 if high is None else max(high * BELOW, 0.85)), (0.1 if low is None else min(low * BELOW, 0.15))


def run_em(x: np.ndarray, n: np.ndarray, start: ModelParams | None = None, max_iterations: int = 25, smoothing: float = 0.0) -> tuple[ModelParams, int]:
    """Parameters from patterns and counts, and the number of iterations run.

    With smoothing (SMOOTHING is the usual amount) no level's probability vanishes, and the thresholds are the fixed ones instead of calibrated.
    """
    if x.shape[1] == 0:
        raise EmptySchema("no fields to compare")
    if not len(x):
        raise NotFitted("no pairs to learn from")
    if start is None:
        share = float((n * (x == 3).any(1)).sum() / n.sum())
        start = initial_params(x.shape[1], min(max(share, 0.001), 0.5))
    p, done = start, 0
    for _ in range(max_iterations):
        new = m_step(x, n, probabilities(x, p), p, smoothing)
        done += 1
        moved, p = change(new, p), new
        if moved < 1e-6:
            break
    p.upper_threshold, p.lower_threshold = SMOOTHED_THRESHOLDS if smoothing else calibrated(probabilities(x, p), n)
    return p, done


def collected(seen: DataFrame, levels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = seen.select(*levels, "n").limit(MAX_PATTERNS + 1).toPandas()
    if len(rows) > MAX_PATTERNS:
        raise NotFitted(f"more than {MAX_PATTERNS} patterns; use spark_em")
    return rows[levels].to_numpy(int), rows["n"].to_numpy(float)


def m_step_table(seen: DataFrame, levels: list[str], p: ModelParams) -> DataFrame:
    """field, level, m_sum, u_sum: one iteration's sums as a Spark aggregation, for more patterns than the driver takes."""
    prob = probability(levels, p)
    long = seen.select(F.col("n").cast("double").alias("n"), prob.alias("p"), F.inline(F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).alias("level")) for i, c in enumerate(levels)))))
    return long.where(F.col("level") != NULL).groupBy("field", "level").agg(F.sum(F.col("n") * F.col("p")).alias("m_sum"), F.sum(F.col("n") * (1 - F.col("p"))).alias("u_sum"))


def spark_em(seen: DataFrame, levels: list[str], start: ModelParams, iterations: int) -> ModelParams:
    """EM whose sums Spark makes; only 4 numbers a field come to the driver in each iteration."""
    return spark_em_counted(seen, levels, start, iterations)[0]


def spark_em_counted(seen: DataFrame, levels: list[str], start: ModelParams, iterations: int) -> tuple[ModelParams, int]:
    """spark_em's parameters and the number of iterations run. The patterns are made once; without any, levels become equally likely."""
    seen, p, done = stored(seen, "patterns"), start, 0
    for _ in range(iterations):
        sums = {(r["field"], r["level"]): (r["m_sum"], r["u_sum"]) for r in m_step_table(seen, levels, p).collect()}
        total = seen.agg(F.sum(F.col("n") * probability(levels, p)).alias("s"), F.sum("n").alias("n")).first()

        def shares(which: int) -> list[list[float]]:
            out = []
            for f in range(len(levels)):
                c = np.array([sums.get((f, v), (0.0, 0.0))[which] for v in range(4)])
                c = np.maximum(c / c.sum() if c.sum() > 0 else np.full(4, 0.25), FLOOR)
                out.append((c / c.sum()).tolist())
            return out

        if total["n"]:
            share = min(max(total["s"] / total["n"], 0.001), 0.999)
            new = ModelParams(shares(0), shares(1), math.log(share / (1 - share)), p.upper_threshold, p.lower_threshold)
        else:
            new = indifferent_params(len(levels))
        done += 1
        moved, p = change(new, p), new
        if moved < 1e-6:
            break
    forget(seen)
    return p, done


def weight(levels: list[str], p: ModelParams) -> Column:
    """The sum of the fields' log weights; NULL fields add nothing."""
    w = log_weights(p)
    parts = [F.coalesce(F.try_element_at(F.array(*(F.lit(float(v)) for v in w[i])), F.col(c).cast("int") + 1), F.lit(0.0)) for i, c in enumerate(levels)]
    return sum(parts[1:], parts[0])


def probability(levels: list[str], p: ModelParams) -> Column:
    return 1 / (1 + F.exp(-(F.lit(p.log_prior_odds) + weight(levels, p))))


def band(prob: Column, p: ModelParams) -> Column:
    return F.when(prob >= p.upper_threshold, AUTO_MATCH).when(prob < p.lower_threshold, AUTO_REJECT).otherwise(BORDERLINE)


def score(compared: DataFrame, levels: list[str], p: ModelParams) -> DataFrame:
    """compared with match_weight, match_probability and band; one codegen projection."""
    d = compared.withColumn("match_weight", weight(levels, p))
    d = d.withColumn("match_probability", 1 / (1 + F.exp(-(F.lit(p.log_prior_odds) + F.col("match_weight")))))
    return d.withColumn("band", band(F.col("match_probability"), p))
