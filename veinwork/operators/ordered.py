"""Numbers, running sums and quantiles along an order, without a whole group in one task: rows are dealt by range of keys and order,
and what lies before a part comes from the parts' sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.sources.scratch import settled


def running(df: DataFrame, keys: list[str], order: list[str], n: str, before: str, total: str) -> DataFrame:
    """df with the sum of n over the rows before, in order, and over all, by keys. A row per keys and order."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled(df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy(*keys, "__part").agg(F.sum(n).alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__at"), zero(F.sum("__sum").over(ahead)).alias("__off"), F.sum("__sum").over(Window.partitionBy(*keys)).alias(total))
    on = F.col("__part") == F.col("__at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(sums, on).withColumn(before, F.col("__off") + zero(F.sum(n).over(within)))
    return out.select(*df.columns, before, total)


def numbered(df: DataFrame, order: list[str], into: str, total: str = "__total") -> DataFrame:
    """df with its place in order, from 0, and the number of rows. A row per order."""
    return running(df.withColumn("__one", F.lit(1)), [], order, "__one", into, total).drop("__one")


def quantiles(df: DataFrame, keys: list[str], value: Column, names: dict[str, float]) -> DataFrame:
    """keys and, by name, quantiles of the value, linear between neighbours: a row per distinct value takes part, not per row."""
    counts = df.select(*keys, value.alias("__v")).where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    r = running(counts, keys, ["__v"], "__n", "__before", "__total")
    holds = lambda i: (F.col("__before") <= i) & (i < F.col("__before") + F.col("__n"))
    at = {k: (F.col("__total") - 1) * F.lit(q) for k, q in names.items()}
    pick = lambda i: F.max(F.when(holds(i), F.col("__v")))
    g = r.groupBy(*keys).agg(*(x for k, i in at.items() for x in (pick(F.floor(i)).alias(f"__lo_{k}"), pick(F.ceil(i)).alias(f"__hi_{k}"), F.max(i - F.floor(i)).alias(f"__w_{k}"))))
    mid = lambda k: F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__w_{k}")
    return g.select(*keys, *(mid(k).alias(k) for k in names))


def with_quantiles(df: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """df joined with a table of quantiles on keys, null ones too; without keys both have one row."""
    if not keys:
        return df.join(F.broadcast(table), how="left")
    other = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(other, on, "left").drop(*(f"__{k}" for k in keys))
