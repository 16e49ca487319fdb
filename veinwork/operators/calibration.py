"""Sigmoid calibration of scores: logistic fits of one number by Newton's method on counts of distinct scores, all keys in one job a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.sources.scratch import settled

STEPS = 12


def score_counts(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, score, pos, neg: a row for each distinct score."""
    hit = F.sum((F.col(y) == 1).cast("double"))
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(hit.alias("pos"), (F.count(F.lit(1)) - hit).alias("neg"))


def applied(score: Column, slope: Column, intercept: Column) -> Column:
    return 1 / (1 + F.exp(-(slope * score + intercept)))


def fit(counts: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """keys, slope, intercept, converged. counts: score_counts(). Targets are drawn in from 0 and 1 by the number of rows (so that separable scores
    have a finite fit); null where there is one class or one score. Each step sums over the counts once; the table of fits has a row
    per keys."""
    data = settled(counts, "calibration")
    totals = data.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"), F.countDistinct("score").alias("__d")).where("__p > 0 and __q > 0 and __d > 1")
    totals = settled(totals.select(*keys, ((F.col("__p") + 1) / (F.col("__p") + 2)).alias("high"), (1 / (F.col("__q") + 2)).alias("low"), F.log((F.col("__p") + 1) / (F.col("__q") + 1)).alias("intercept")), "calibration-start")
    now = totals.withColumn("slope", F.lit(0.0)).withColumn("moved", F.lit(None).cast("double"))
    s, n = F.col("score"), F.col("pos") + F.col("neg")
    for _ in range(steps):
        p = applied(s, F.col("slope"), F.col("intercept"))
        off = F.col("pos") * F.col("high") + F.col("neg") * F.col("low") - n * p
        w = n * p * (1 - p)
        rows = data.join(F.broadcast(now), keys) if keys else data.join(F.broadcast(now), how="inner")
        sums = rows.groupBy(*keys, "high", "low", "slope", "intercept").agg(F.sum(off).alias("g0"), F.sum(off * s).alias("g1"), F.sum(w).alias("h00"), F.sum(w * s).alias("h01"), F.sum(w * s * s).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        up = lambda a: F.when(det > 0, a / det).otherwise(0.0)
        more = up(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"))
        level = up(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"))
        now = settled(sums.select(*keys, "high", "low", (F.col("slope") + more).alias("slope"), (F.col("intercept") + level).alias("intercept"), (F.abs(more) + F.abs(level)).alias("moved")), "calibration-step")
    return now.select(*keys, "slope", "intercept", (F.col("moved") < 1e-6).alias("converged"))
