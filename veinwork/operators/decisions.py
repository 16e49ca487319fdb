"""Decisions and gates over scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def prevalence_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """The quantile of the score at 1 - prevalence, linear between neighbours. The two neighbours are found by counts of score
    buckets and the ranks within them; nothing is sorted whole."""
    b = F.least(F.floor(F.col(score) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    d = df.where(F.col(score).isNotNull()).select(F.col(y).alias("y"), F.col(score).alias("s"), b.alias("b"))
    counts = d.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("p"))
    all_, ahead = Window.partitionBy(), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.sum("c").over(all_) - 1) * (1 - F.sum("p").over(all_) / F.sum("c").over(all_))
    counts = counts.select("b", "c", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"), at.alias("at"))
    near = counts.where("floor(at) < before + c and ceil(at) >= before")
    ranked = d.join(near, "b").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("s")) - 1)
    pick = lambda f: F.min(F.when(F.col("i") == f(F.col("at")), F.col("s")))
    low, high = pick(F.floor), pick(F.ceil)
    return ranked.agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("threshold"))


def two_stage(paired: DataFrame, key: str, first: str, second: str, low: str | None = None, pool: int = 3, tie: float = 1e-9) -> DataFrame:
    """The best `second` among the `pool` best by `first` (by `low` where every valid row has it). Abstains on fewer than pool valid
    rows, fewer than two with a second score, or a tie at the top. One row."""
    valid = paired.where(F.col(first).isNotNull())
    counts = valid.agg(F.count(F.lit(1)).alias("valid"), (F.bool_and(F.col(low).isNotNull()) if low else F.lit(False)).alias("has_low"))
    by = F.when(F.col("has_low"), F.col(low) if low else F.col(first)).otherwise(F.col(first))
    best = valid.join(F.broadcast(counts), how="inner").select(F.col(key).alias("k"), by.alias("a"), F.col(second).alias("b"), "valid").orderBy(F.desc("a"), "k").limit(pool)
    row = best.agg(F.max("valid").alias("valid"), F.sort_array(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", (-F.col("k")).alias("k")))), asc=False).alias("s"))
    top, next_ = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    status = F.when(F.coalesce("valid", F.lit(0)) < pool, "too_few_valid").when(F.size("s") < 2, "too_few_scored").when(top["b"] - next_["b"] <= tie, "tie").otherwise("decided")
    return row.select(status.alias("status"), F.when(status == "decided", -top["k"]).alias("winner"), F.coalesce("valid", F.lit(0)).alias("valid"))


def reasons(**checks: Column) -> Column:
    """The names of the checks that fail, in order; a null check fails."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))), ",")


def independence_gate(cases: DataFrame, y: str, duplicate: Column, near: Column, least: int = 50, positives: int = 10) -> DataFrame:
    """One row: the counts, the failed checks, approved. An empty table isn't approved."""
    g = cases.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum(y), F.lit(0)).alias("positives"), F.count_if(duplicate).alias("duplicates"), F.count_if(near).alias("near"))
    why = reasons(enough_cases=F.col("cases") >= least, enough_positives=F.col("positives") >= positives, no_duplicates=F.col("duplicates") == 0, none_near=F.col("near") == 0)
    return g.withColumn("reasons", why).withColumn("approved", F.col("reasons") == "")


def candidate_gate(active: DataFrame, candidate: DataFrame, keys: list[str], higher: list[str], lower: list[str]) -> DataFrame:
    """keys, reasons, better, approved: no metric worse and one better. Both sides have a row per key."""
    c = candidate.select(*keys, *(F.col(x).alias(f"new_{x}") for x in higher + lower))
    j = active.join(c, keys)
    gain = {x: F.col(f"new_{x}") - F.col(x) for x in higher} | {x: F.col(x) - F.col(f"new_{x}") for x in lower}
    better = F.coalesce(F.array_max(F.array(*(g.cast("double") for g in gain.values()))) > 0, F.lit(False))
    out = j.select(*keys, reasons(**{k: g >= 0 for k, g in gain.items()}).alias("reasons"), better.alias("better"))
    return out.withColumn("approved", (F.col("reasons") == "") & F.col("better"))


def complete_once(expected: DataFrame, tested: DataFrame, key: str) -> DataFrame:
    """Violations of "every row tested exactly once": (key, times)."""
    n = tested.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return expected.select(key).distinct().join(n, key, "full").withColumn("times", F.coalesce("times", F.lit(0))).where("times <> 1")


def isolated(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that several folds share."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def assert_complete(expected: DataFrame, tested: DataFrame, key: str) -> None:
    from .joins import assert_empty

    assert_empty(complete_once(expected, tested, key), f"rows of {key} not tested exactly once")
