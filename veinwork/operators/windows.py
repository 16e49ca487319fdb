"""Dedupe, ranks and ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.operators.ordered import running


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order; null keys equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def multiplicity(df: DataFrame, keys: list[str], into: str = "n_same") -> DataFrame:
    """How many rows share the row's keys: counted first, then joined, so that a frequent key is no hot window."""
    counts = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias(into))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(counts, on, "left").drop(*(f"__{k}" for k in keys))


def unique_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """case_id: the name, its repeats with __2, __3, ... in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("case_id", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), n.cast("string"))))


def change(df: DataFrame, keys: list[str], order: str, value: str, into: str = "change") -> DataFrame:
    return df.withColumn(into, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def average_rank(df: DataFrame, value: str, keys: list[str], into: str = "rank") -> DataFrame:
    """Ranks with ties at their mean: positions come from the distinct values, not from the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running(counts, keys, [value], "__n", "__b", "__t").withColumn(into, F.col("__b") + (F.col("__n") + 1) / 2.0).drop("__n", "__b", "__t")
    return df.join(ranks, [*keys, value], "left")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def leaderboard(df: DataFrame, order: list, ok: Column) -> DataFrame:
    """rank among the rows that are ok; others follow without one. One row per algorithm, so a small table."""
    ranked = df.where(ok).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.unionByName(df.where(~ok).withColumn("rank", F.lit(None).cast("int")))


def error_share(df: DataFrame, error: Column, tops: tuple[int, ...], key: str) -> DataFrame:
    """Share of the squared error that the largest errors hold."""
    squares = df.select((error * error).alias("e"), F.col(key).alias("k"))
    total = squares.agg(F.sum("e").alias("total"))
    parts = [squares.orderBy(F.desc("e"), "k").limit(n).agg(F.sum("e").alias("part")).select(F.lit(n).alias("top"), "part") for n in tops]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(total, how="inner").select("top", (F.col("part") / F.col("total")).alias("share"))


def round_robin(df: DataFrame, group: list[str], order: list, limit: int, cell: str | None = None, paper: str | None = None, per_paper: int = 1) -> DataFrame:
    """A balanced queue: the best row of each cell, the best per_paper rows of each paper, then one row of every group in turn."""
    if cell:
        df = keep_first(df, [cell], order)
    if paper:
        df = df.withColumn("__p", F.row_number().over(Window.partitionBy(paper).orderBy(*order))).where(F.col("__p") <= per_paper).drop("__p")
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return turn.orderBy("turn", *group).limit(limit)
