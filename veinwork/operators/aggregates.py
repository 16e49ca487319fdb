"""Table audits and grouped summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.columns import CORE_OXIDES, OXIDES, closure, present
from veinwork.operators.ordered import quantiles, with_quantiles


def stage_audit(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, rows, columns, missing cells; one pass over each stage."""
    one = lambda name, df: df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))), F.lit(0)).alias("missing"))
    return reduce(DataFrame.unionByName, (one(k, v) for k, v in stages.items()))


def coordinate_diagnostics(df: DataFrame, lat: str, lon: str) -> DataFrame:
    there = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ok = there & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid"), F.count_if(~there).alias("missing"), F.count_if(there & ~ok).alias("out_of_range"), F.avg(ok.cast("double")).alias("coverage"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    d = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value as text), a row per cell."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")


def feature_manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = long_form(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_fraction"), F.count("value").alias("distinct_values"))


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    counts = long_form(df, columns).where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))).where(F.col("place") <= n)


def protocol_masks(df: DataFrame, lower: float = 94.0, upper: float = 102.0, minimum_majors: int = 8, traces: tuple[str, ...] = ("Rb", "Sr"), source_ok: Column | None = None, valid: Column | None = None) -> DataFrame:
    """A measured total, B complete reconstruction, C provisional coverage: boolean columns and qc_status."""
    total, n = closure(*OXIDES), present(*OXIDES)
    recovered = F.coalesce("measured_total", total)
    within = lambda x, lo: F.coalesce(x.between(lo, upper), F.lit(False))
    a, b = within(F.col("measured_total"), lower), within(recovered, lower)
    partial = F.when(n >= minimum_majors, reduce(lambda x, y: x + y, (F.coalesce(F.col(o), F.lit(0.0)) for o in OXIDES)))
    physical = ~reduce(lambda x, y: x | y, (F.coalesce((F.col(o) < 0) | (F.col(o) > 100), F.lit(False)) for o in OXIDES))
    c = F.col("measured_total").isNull() & total.isNull() & physical & (present(*CORE_OXIDES) == len(CORE_OXIDES)) & (n >= minimum_majors) & (present(*traces) >= 2) & within(partial, 70.0)
    c = c & F.coalesce(source_ok if source_ok is not None else F.lit(True), F.lit(False)) & F.coalesce(valid if valid is not None else F.lit(True), F.lit(False))
    status = F.when(c, "C_UNVERIFIED_EXPERIMENT_ONLY").when(b & ~a, "B_COMPLETE_RECONSTRUCTION").when(a, "A_MEASURED_OR_PRECOMPUTED").otherwise("REJECTED")
    return df.withColumns({"A_original": a, "B_reconstructed": b, "C_experimental": b | c, "C_unverified_extra": c, "qc_status": status})


def protocol_summary(masked: DataFrame, source: str = "source") -> DataFrame:
    """source, protocol, rows, total, more than A."""
    names = ["A_original", "B_reconstructed", "C_experimental"]
    g = masked.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(x)).alias(x) for x in names))
    rows = F.array(*(F.struct(F.lit(x).alias("protocol"), F.col(x).alias("rows"), (F.col(x) - F.col(names[0])).alias("additional")) for x in names))
    return g.select("source", "total", F.inline(rows))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Share of the largest and five largest groups, effective number of groups, singletons."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    all_ = g.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count_if(F.col("n") == 1).alias("singletons"))
    head = g.orderBy(F.desc("n"), key).limit(5).agg(F.max("n").alias("first"), F.sum("n").alias("five"))
    return all_.join(head, how="inner").select("groups", "singletons", (F.col("first") / F.col("total")).alias("top1_share"), (F.col("five") / F.col("total")).alias("top5_share"), (F.col("total") * F.col("total") / F.col("squares")).alias("effective_groups"))


def distribution(df: DataFrame, value: str, keys: list[str], cutoffs: tuple[float, ...] = ()) -> DataFrame:
    names = {"median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    d = df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), *(F.count_if(F.col(value) > c).alias(f"over_{c:g}") for c in cutoffs))
    return with_quantiles(d, keys, quantiles(df, keys, F.col(value), names)).select(*keys, "n", *names, "max", "std", *(f"over_{c:g}" for c in cutoffs))


def profile(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: the low and high quantile of each feature."""
    one = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))))
    long = quantiles(one, ["feature"], F.col("value"), {"lo": low, "hi": high})
    return long.groupBy().agg(*(F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"{s}_{c}") for c in columns for s in ("lo", "hi")))


def applicability(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """outside: the share of features that are null or outside the profile. The profile is one row."""
    from veinwork.functions.columns import outside_share

    share = outside_share({c: F.col(c) for c in columns}, {c: F.col(f"lo_{c}") for c in columns}, {c: F.col(f"hi_{c}") for c in columns})
    return df.join(F.broadcast(bounds), how="inner").withColumn("outside", share).drop(*bounds.columns)


def strata(df: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """A row for each (row, subset it belongs to); subsets may overlap."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in subsets.items())))
    return df.withColumn("subset", F.explode(named))


def correlations(df: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of each pair, over the rows that have both; null below three rows or without spread."""
    from .windows import average_rank

    out = []
    for a, b in pairs:
        d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("__k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        r = average_rank(average_rank(d, "a", [], "ra"), "b", [], "rb")
        ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
        out.append(r.agg(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("a", "b")).alias("pearson"), F.when(ok, F.corr("ra", "rb")).alias("spearman")))
    return reduce(DataFrame.unionByName, out)
