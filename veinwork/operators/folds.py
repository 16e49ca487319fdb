"""Folds, held-out training sets and resampling, all deterministic: draws come from md5 of seed, replicate and place."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.operators.ordered import numbered, quantiles


def draw(*parts: Column | str | int) -> Column:
    """A whole number in [0, 2^32) from the parts."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number from the parts: Box and Muller's transform of two draws of one hash."""
    h = F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((part(1) + 0.5) / float(1 << 32))) * F.cos(part(9) * (2 * math.pi / (1 << 32)))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): the largest group first, each to the lightest fold so far; ties by name. Works on the table of groups."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))

    def run(frames):
        load = [(0, k) for k in range(folds)]
        for x in frames:
            out = []
            for n in x["n"]:
                rows, k = heapq.heappop(load)
                out.append(k)
                heapq.heappush(load, (rows + int(n), k))
            yield x[[group]].assign(fold=out)

    # each group's fold hangs on all before it, so the table of groups (spatial cells: as many as the earth has) goes through one task, row by row
    return sizes.repartition(1).sortWithinPartitions(F.desc("n"), group).mapInPandas(run, f"{group} {dict(df.dtypes)[group]}, fold int")


def nested_folds(df: DataFrame, group: str, folds: int, inner: int, fold: str = "fold") -> DataFrame:
    """(outer, group, inner): the groups of each outer fold's training rows, dealt among themselves as group_folds() deals all."""
    sizes = df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("n"))
    outer = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("outer")
    train = sizes.select("*", outer).where(F.col("outer") != F.col(fold)).groupBy("outer", group).agg(F.sum("n").alias("n"))

    def run(frames):
        at, load = None, []
        for x in frames:
            out = []
            for k, n in zip(x["outer"], x["n"]):
                if k != at:
                    at, load = k, [(0, i) for i in range(inner)]
                rows, i = heapq.heappop(load)
                out.append(i)
                heapq.heappush(load, (rows + int(n), i))
            yield x[["outer", group]].assign(inner=out)

    # as in group_folds(): a task takes the table of groups of one or more outer folds, row by row
    return train.repartition(folds, "outer").sortWithinPartitions("outer", F.desc("n"), group).mapInPandas(run, f"outer int, {group} {dict(df.dtypes)[group]}, inner int")


def training_rows(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """A row for each fold that a row trains in, as train_fold."""
    return df.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("train_fold") != F.col(fold))


def fold_thresholds(df: DataFrame, value: str, folds: int, q: float = 0.75) -> DataFrame:
    """train_fold, threshold: the quantile of the value among the fold's training rows."""
    return quantiles(training_rows(df, folds), ["train_fold"], F.col(value), {"threshold": q})


def fold_labels(df: DataFrame, value: str, folds: int, q: float = 0.75) -> DataFrame:
    """Each row's label under the threshold of the fold that tests it."""
    t = fold_thresholds(df, value, folds, q).withColumnRenamed("train_fold", "fold")
    return df.join(t, "fold").withColumn("label", (F.col(value) >= F.col("threshold")).cast("int"))


def baseline(df: DataFrame, value: str, folds: int) -> DataFrame:
    """Each row with the mean of its fold's training rows as pred, from sums by fold alone."""
    sums = df.groupBy("fold").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    everything = Window.partitionBy()
    means = sums.select("fold", ((F.sum("s").over(everything) - F.col("s")) / (F.sum("n").over(everything) - F.col("n"))).alias("pred"))
    return df.join(means, "fold")


def bootstrap_weights(groups: DataFrame, group: str, replicates: int, seed: str) -> DataFrame:
    """(rep, group, weight): how often each of G groups is drawn in G draws with replacement."""
    some = numbered(groups.select(group).distinct(), [group], "i")
    n = groups.select(group).distinct().count()
    draws = groups.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("rep"), (F.col("id") % max(n, 1)).alias("k"))
    draws = draws.withColumn("i", draw(seed, F.col("rep"), F.col("k")) % max(n, 1)).groupBy("rep", "i").agg(F.count(F.lit(1)).alias("weight"))
    return draws.join(some, "i").select("rep", group, "weight")


def bootstrap_mae(df: DataFrame, group: str, replicates: int = 100, seed: str = "b1", y: str = "y", pred: str = "pred") -> DataFrame:
    """Percentile interval of the mean absolute error under resampling of whole groups, from one sum per group."""
    sums = df.groupBy(group).agg(F.sum(F.abs(F.col(pred) - F.col(y))).alias("e"), F.count(F.lit(1)).alias("n"))
    reps = bootstrap_weights(sums, group, replicates, seed).join(sums, group).groupBy("rep").agg((F.sum(F.col("e") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("mae"))
    p = F.percentile("mae", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return reps.agg(F.count(F.lit(1)).alias("replicates"), p[0].alias("low"), p[1].alias("median"), p[2].alias("high"))


def bootstrap_auc(df: DataFrame, group: str, replicates: int = 20, seed: str = "b1", y: str = "y", score: str = "score") -> DataFrame:
    """rep, auc, ap for resampled groups, by the weighted ranking of (group, score) counts."""
    from .metrics import ranking

    counts = df.groupBy(group, y, score).agg(F.count(F.lit(1)).alias("__n"))
    w = bootstrap_weights(df, group, replicates, seed)
    return ranking(counts.join(w, group).withColumn("w", (F.col("__n") * F.col("weight")).cast("double")), ["rep"], y, score, "w")


def group_subset(df: DataFrame, group: str, fraction: float, seed: str, least: int = 3) -> DataFrame:
    """The rows of a nested random subset of groups: a smaller fraction's groups are in a larger one's."""
    groups = numbered(df.select(group).distinct().withColumn("__draw", draw(seed, F.col(group))), ["__draw", group], "place", "groups")
    return df.join(groups.where(F.col("place") < F.greatest(F.lit(least), F.round(F.col("groups") * fraction))).select(group), group, "left_semi")


def site_weights(df: DataFrame, site: str) -> DataFrame:
    """weight: 1 / rows of the site, scaled to a mean of 1."""
    n = df.groupBy(site).agg(F.count(F.lit(1)).alias("__n"))
    mean = n.agg((F.count(F.lit(1)) / F.sum("__n")).alias("__m"))
    return df.join(n, site).join(mean, how="inner").withColumn("weight", 1 / F.col("__n") / F.col("__m")).drop("__n", "__m")


def perturbed(df: DataFrame, column: str, key: str, share: float = 0.1, factor: float = 3.0, seed: str = "p1") -> DataFrame:
    """scenario and value: the column as is, with a share missing, and times a factor."""
    u = draw(seed, F.col(key)) / float(1 << 32)
    s = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col(column).alias("value")),
        F.struct(F.lit("missing").alias("scenario"), F.when(u >= share, F.col(column)).alias("value")),
        F.struct(F.lit("extreme").alias("scenario"), (F.col(column) * factor).alias("value")),
    )
    return df.select(key, F.inline(s))
