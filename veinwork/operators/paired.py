"""Two scores of the same rows compared: paired rows, and confidence intervals under resampling of whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators import metrics as m
from veinwork.operators.folds import draw
from veinwork.operators.joins import assert_empty, one_to_one
from veinwork.operators.ordered import running
from veinwork.sources.scratch import settled

#: What an interval needs at least.
LEAST_GROUPS, LEAST_DRAWS = 5, 20
METRICS = ("auc", "ap", "brier")
#: Replicates whose weights lie side by side in a row.
BLOCK = 40


def pairs(reference: DataFrame, candidate: DataFrame, key: str, y: str = "y", score: str = "score") -> DataFrame:
    """reference's columns with its score as `reference` and the other's as `candidate`. Both have the same keys, once each, with the same
    labels and finite scores; else an error."""
    left = reference.withColumnRenamed(score, "reference")
    right = candidate.select(key, F.col(y).alias("__y"), F.col(score).alias("candidate"), F.lit(1).alias("__there"))
    both = one_to_one(left.withColumn("__here", F.lit(1)), right, [key], "full")
    assert_empty(both.where("__here is null or __there is null"), "the arms cover different rows")
    assert_empty(both.where(~F.col(y).eqNullSafe(F.col("__y"))), "the arms disagree on labels")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    assert_empty(both.where(bad("reference") | bad("candidate")), "scores that aren't finite")
    return both.drop("__y", "__here", "__there")


def group_draws(groups: DataFrame, keys: list[str], group: str, replicates: int, seed: str) -> DataFrame:
    """keys, rep, group, weight: how often each of the G groups of a key is drawn in G draws with replacement. A row per key and group."""
    some = running(groups.select(*keys, group).withColumn("__one", F.lit(1)), keys, [group], "__one", "__i", "__g").drop("__one")
    # one draw for each group and replicate: which of the groups it takes
    taken = draw(seed, F.col("rep"), F.col("__i")) % F.col("__g")
    drawn = some.select(*keys, "__i", "__g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select(*keys, "rep", taken.alias("__i"))
    drawn = drawn.groupBy(*keys, "rep", "__i").agg(F.count(F.lit(1)).alias("weight"))
    return drawn.join(some.drop("__g"), [*keys, "__i"]).select(*keys, "rep", group, "weight")


def _arms(df: DataFrame, keep: list[str], y: str) -> DataFrame:
    """A row for each arm, keep, label and distinct score, with the number of rows."""
    arms = F.inline(F.array(*(F.struct(F.lit(a).alias("__arm"), F.col(a).alias("score")) for a in ("reference", "candidate"))))
    return df.select(*keep, F.col(y).alias("y"), arms).groupBy(*keep, "y", "__arm", "score").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _drawn(counts: DataFrame, weights: DataFrame, keys: list[str], group: str, replicates: int) -> DataFrame:
    """keys, rep, __arm, y, score, n: counts summed under each replicate's weights. A count meets the weights of BLOCK replicates at once, as
    columns, so rows aren't multiplied by replicates until they are summed by score."""
    size = min(BLOCK, replicates)
    of = lambda i: F.coalesce(F.sum(F.when(F.col("rep") % size == i, F.col("weight"))), F.lit(0)).cast("double").alias(f"__w{i}")
    wide = weights.groupBy(*keys, group, F.floor(F.col("rep") / size).cast("int").alias("__block")).agg(*map(of, range(size)))
    sums = counts.join(wide, [*keys, group]).groupBy(*keys, "__block", "__arm", "y", "score").agg(*(F.sum(F.col("n") * F.col(f"__w{i}")).alias(f"__w{i}") for i in range(size)))
    each = F.inline(F.array(*(F.struct((F.col("__block") * size + i).alias("rep"), F.col(f"__w{i}").alias("n")) for i in range(size))))
    return sums.select(*keys, "__arm", "y", "score", each).where("n > 0")


def _measures(counts: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """keys, metric, reference, candidate, of weighted counts; null where there is one class."""
    by = [*keys, "__arm"]
    w = counts.withColumn("__w", F.col("n") * weight)
    error = F.sum(F.col("__w") * (F.col("score") - F.col("y")) ** 2) / F.sum("__w")
    both = w.groupBy(*by).agg(error.alias("brier")).join(m.ranking(w, by, weight="__w"), by)
    value = F.when(F.col("auc").isNotNull(), F.col("value"))
    long = both.select(*by, "auc", F.inline(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in METRICS)))).select(*by, "metric", value.alias("value"))
    side = lambda a: F.max(F.when(F.col("__arm") == a, F.col("value"))).alias(a)
    return long.groupBy(*keys, "metric").agg(side("reference"), side("candidate"))


def _change() -> Column:
    """Candidate less reference, without what the order of a sum leaves of equal ones."""
    return F.round(F.col("candidate") - F.col("reference"), 12)


def bootstrap(df: DataFrame, keys: list[str], group: str, replicates: int = 500, seed: str = "pb", y: str = "y") -> DataFrame:
    """keys, metric, reference, candidate, delta (candidate less reference), n, groups, draws, low, high, includes_zero, status.

    df: keys, group, y and the scores reference and candidate (pairs()). The same draw of groups weighs both arms; draws of one class are
    left out. With fewer than LEAST_GROUPS groups, or draws of fewer than half of the replicates (LEAST_DRAWS at least), there is
    no interval and status says why. Draws weigh counts of (group, label, score), never rows; the interval is the
    2.5th to the 97.5th percentile of the delta."""
    counts = settled(_arms(df, [*keys, group], y), "paired-counts")
    point = _measures(counts.groupBy(*keys, "__arm", "y", "score").agg(F.sum("n").alias("n")), keys, F.lit(1.0))
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"))
    weights = group_draws(counts.select(*keys, group).distinct(), keys, group, replicates, seed)
    drawn = settled(_drawn(counts, weights, keys, group, replicates), "paired-draws")
    deltas = _measures(drawn, [*keys, "rep"], F.lit(1.0)).withColumn("delta", _change())
    p = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    spread = deltas.groupBy(*keys, "metric").agg(F.count("delta").alias("draws"), p[0].alias("low"), p[1].alias("high"))
    joined = point.join(spread, [*keys, "metric"])
    out = joined.join(size, keys) if keys else joined.join(F.broadcast(size), how="inner")
    few = F.when(F.col("groups") < LEAST_GROUPS, "too_few_groups").when(F.col("draws") < max(LEAST_DRAWS, replicates // 2), "too_few_draws").otherwise("ok")
    out = out.withColumn("status", few)
    ok = F.col("status") == "ok"
    zero = (F.col("low") <= 0) & (F.col("high") >= 0)
    return out.select(*keys, "metric", "reference", "candidate", _change().alias("delta"), "n", "groups", "draws", F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"), F.when(ok, zero).alias("includes_zero"), "status")
