"""Calibration and evaluation statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_bucket(seed: str, key: Column) -> Column:
    """0 to 9999 from the first three bytes of SHA-256("seed:key")."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 6), 16, 10).cast("int") % 10000


def smoothed_rates(df: DataFrame, truth: str, state: str, states: list[str], alpha: float = 1.0) -> DataFrame:
    """(state, m, u): the states' rates among matches and non-matches, with alpha added to each."""
    counts = df.groupBy(state).agg(F.sum(F.col(truth)).alias("c1"), F.sum(1 - F.col(truth)).alias("c0"))
    every = df.sparkSession.createDataFrame([(s,) for s in states], f"{state} string").join(F.broadcast(counts), state, "left").na.fill(0)
    total = df.agg(F.sum(F.col(truth)).alias("t1"), F.sum(1 - F.col(truth)).alias("t0"))
    k = len(states)
    return every.join(F.broadcast(total), F.lit(True)).select(state, ((F.col("c1") + alpha) / (F.col("t1") + alpha * k)).alias("m"), ((F.col("c0") + alpha) / (F.col("t0") + alpha * k)).alias("u"))


def non_increasing(m: list[float], u: list[float]) -> list[float]:
    """Ratios m/u made non-increasing by pooling neighbours (sums of m over sums of u)."""
    blocks: list[list[float]] = []
    for a, b in zip(m, u, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] > blocks[-2][0] * blocks[-1][1]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    return [a / b for a, b, n in blocks for _ in range(int(n))]


def kish(weights: Column) -> Column:
    """Effective sample size of design weights."""
    return F.sum(weights) * F.sum(weights) / F.sum(weights * weights)


def binomial_upper(errors: int, n: int, alpha: float) -> float:
    """The exact upper bound of a rate: p with P(X <= errors) = alpha, by bisection."""
    if errors >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(errors + 1)]
        top = max(logs)
        return top + math.log(sum(math.exp(x - top) for x in logs))

    lo, hi = 1e-15, 1 - 1e-15
    for _ in range(70):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > math.log(alpha) else (lo, mid)
    return hi


def link_quality(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and rates of links: truth and predicted are ids, null for none. A link to a wrong id is a false and a missed link."""
    t, p = F.col(truth), F.col(predicted)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(n(t == p).alias("tl"), n(p.isNotNull() & ~t.eqNullSafe(p)).alias("fl"), n(t.isNotNull() & ~t.eqNullSafe(p)).alias("ml"), n(t.isNull() & p.isNull()).alias("tnl"))
    return c.withColumns({"recall": F.try_divide("tl", F.col("tl") + F.col("ml")), "precision": F.try_divide("tl", F.col("tl") + F.col("fl")), "fpr": F.try_divide("fl", F.col("fl") + F.col("tnl"))})


def b_cubed(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(precision, recall) of B-cubed, from the counts of (cluster, truth) alone."""
    joint = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    c = joint.groupBy(cluster).agg(F.sum("n").alias("nc"))
    t = joint.groupBy(truth).agg(F.sum("n").alias("nt"))
    j = joint.join(c, cluster).join(t, truth)
    n = F.col("n").cast("double")
    return j.agg((F.sum(n * n / F.col("nc")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("nt")) / F.sum(n)).alias("recall"))


def checked_ratios(levels: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """levels (*by, place, m, u) as they are; reading one whose log ratio is above that of the place before it, by more than tolerance, is an error."""
    w = Window.partitionBy(*by).orderBy("place")
    llr = F.ln(F.col("m") / F.col("u"))
    rises = F.coalesce(llr > F.lag(llr).over(w) + tolerance, F.lit(False))
    d = levels.withColumn("_rises", rises)
    sure = F.when(F.col("_rises"), F.raise_error(F.concat(F.lit("the log ratio rises at place "), F.col("place").cast("string"))).cast("boolean")).otherwise(True)
    return d.where(sure).drop("_rises")
