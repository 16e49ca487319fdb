"""Grouped, weighted metrics. Rankings work on distinct scores, cumulated in two levels: score buckets, then scores within
one, so no group is a single window however many scores it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.operators.ordered import quantiles, with_quantiles

BUCKETS = 256


def _bucket(score: Column) -> Column:
    """A bucket that grows with the score: of equal width within 0 to 1, by size of the number outside, so that no range is one bucket."""
    far = lambda x: (F.floor(F.log2(x) * 8) + 1024 * 8 + 16).cast("int")
    return F.when(score < 0, -far(-score)).when(score > 1, F.lit(BUCKETS) + far(score)).otherwise(F.floor(score * BUCKETS).cast("int"))


def regression(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.col(pred) - F.col(y)
    spread = F.var_pop(y)
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.when(spread > 0, 1 - F.avg(e * e) / spread).alias("r2"),
        F.when(spread > 0, 1 - F.var_pop(e) / spread).alias("explained"),
    )
    out = with_quantiles(sums, keys, quantiles(rows, keys, F.abs(e), {"median_ae": 0.5, "p90_ae": 0.9}))
    return out.select(*keys, "n", "rmse", "mae", "median_ae", "p90_ae", "bias", "r2", "explained")


def confusion(df: DataFrame, keys: list[str], threshold: Column | float = 0.5, y: str = "y", score: str = "score", zero_division: float | None = 0.0) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    c = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"), F.avg(F.col(y).cast("double")).alias("prevalence"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(zero_division).cast("double"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("specificity", share(tn, tn + fp))
    return c.withColumn("f1", share(2 * tp, 2 * tp + fp + fn)).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def by_score(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """keys, score, pos, neg and what lies strictly above: pos_above, neg_above; pos_all, neg_all."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg")
    )
    d = d.withColumn("__b", _bucket(F.col("score")))
    b = d.groupBy(*keys, "__b").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    over, everything = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    b = b.select(*keys, "__b", zero(F.sum("__p").over(over)).alias("__pa"), zero(F.sum("__n").over(over)).alias("__na"), F.sum("__p").over(everything).alias("pos_all"), F.sum("__n").over(everything).alias("neg_all"))
    within = Window.partitionBy(*keys, "__b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    j = d.join(b, [*keys, "__b"])
    return j.withColumn("pos_above", F.col("__pa") + zero(F.sum("pos").over(within))).withColumn("neg_above", F.col("__na") + zero(F.sum("neg").over(within))).drop("__b", "__pa", "__na")


def ranking(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """ROC AUC (ties count half) and average precision; null where a group has one class."""
    d = by_score(df, keys, y, score, weight)
    wins = F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)
    gain = F.when(F.col("pos") > 0, F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")))
    out = d.groupBy(*keys).agg(F.sum(wins).alias("__w"), F.sum(gain).alias("__g"), F.max("pos_all").alias("__p"), F.max("neg_all").alias("__q"))
    both = (F.col("__p") > 0) & (F.col("__q") > 0)
    return out.select(*keys, F.when(both, F.col("__w") / (F.col("__p") * F.col("__q"))).alias("auc"), F.when(both, F.col("__g") / F.col("__p")).alias("ap"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate")).withColumn("gap", F.col("rate") - F.col("mean_score"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    r = reliability(df, keys, bins, y, score)
    return r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def operating_threshold(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The threshold of the best balanced accuracy, then F1, recall, nearness to 0.5, then the lowest. Candidates: 0, 0.5, 1, all
    scores and the midpoints between neighbours; each one's counts are those of the lowest score at or above it."""
    d = by_score(df, keys, y, score)
    d = d.withColumn("tp", F.col("pos_above") + F.col("pos")).withColumn("fp", F.col("neg_above") + F.col("neg"))
    buckets = _bucket(F.col("score"))
    d = d.withColumn("__b", buckets)
    low = d.groupBy(*keys, "__b").agg(F.max("score").alias("__top"))
    low = low.withColumn("__below", F.max("__top").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    prev = F.coalesce(F.lag("score").over(Window.partitionBy(*keys, "__b").orderBy("score")), F.col("__below"))
    d = d.join(low, [*keys, "__b"]).withColumn("prev", prev)
    # what a fixed candidate takes is what the lowest score at or above it takes
    fixed = [F.when((F.col("score") >= t) & (F.col("prev").isNull() | (F.col("prev") < t)), F.lit(t)) for t in (0.0, 0.5, 1.0)]
    middle = F.when(F.col("prev").isNotNull(), (F.col("prev") + F.col("score")) / 2)
    c = d.select(*keys, "tp", "fp", "pos_all", "neg_all", F.explode(F.array_compact(F.array(F.col("score"), middle, *fixed))).alias("threshold"))
    # above every score: nothing is taken
    ends = d.groupBy(*keys).agg(F.max("score").alias("m"), F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"))
    none = ends.select(*keys, F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"), "pos_all", "neg_all", F.explode(F.array_compact(F.array(*(F.when(F.col("m") < t, F.lit(t)) for t in (0.0, 0.5, 1.0))))).alias("threshold"))
    c = c.unionByName(none).where("pos_all > 0 and neg_all > 0")
    recall, spec = F.col("tp") / F.col("pos_all"), 1 - F.col("fp") / F.col("neg_all")
    f1 = 2 * F.col("tp") / (F.col("pos_all") + F.col("tp") + F.col("fp"))
    key = F.struct(F.round((recall + spec) / 2, 12).alias("balanced_accuracy"), F.round(f1, 12).alias("f1"), F.round(recall, 12).alias("recall"), F.round(-F.abs(F.col("threshold") - 0.5), 12).alias("near"), (-F.col("threshold")).alias("low"))
    return c.groupBy(*keys).agg(F.max(key).alias("k")).where("k is not null").select(*keys, (-F.col("k.low")).alias("threshold"), "k.balanced_accuracy", "k.f1", "k.recall")
