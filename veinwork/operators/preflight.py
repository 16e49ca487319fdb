"""Checks before a fit: one pass profiles every column alike, and findings are read off the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators.joins import assert_empty
from veinwork.sources.scratch import settled

#: Names of identifiers and of provenance, lower case.
IDENTIFIERS = ("source_dataset", "source_sample", "sample_id", "sample", "unique_id", "id")


def profile(df: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
    """A row for each column: name, n, missing, non_finite, constant, equal_target (of the rows where both have a value: both), fingerprint (of
    which value stands at which key, so that columns of equal content share it). One aggregation, whatever the number of columns."""
    kinds, t = dict(df.dtypes), F.col(f"`{target}`")
    known = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf")) if kinds[target] in ("double", "float") else t.isNotNull()
    rows = []
    for i, name in enumerate(columns):
        v, real = F.col(f"`{name}`"), kinds[name] in ("double", "float")
        bad = (F.isnan(v) | (F.abs(v) == float("inf"))) if real else F.lit(False)
        has = v.isNotNull() & ~bad
        both = has & known
        mark = F.xxhash64(F.col(f"`{key}`"), v.cast("double") if real or kinds[name] in ("int", "bigint", "smallint", "tinyint") else v.cast("string"))
        comparable = kinds[name] == kinds[target] or real and kinds[target] in ("double", "float")
        rows.append((name, f"{i}", [
            F.count_if(v.isNull() | bad).alias(f"m{i}"), F.count_if(v.isNotNull() & bad).alias(f"f{i}"), F.min(F.when(has, v)).eqNullSafe(F.max(F.when(has, v))).alias(f"c{i}"),
            (F.count_if(both & (v == t)) if comparable else F.lit(0).cast("bigint")).alias(f"e{i}"), F.count_if(both).alias(f"b{i}"), F.sum(F.when(has, mark.cast("decimal(20,0)"))).alias(f"p{i}"),
        ]))
    one = df.agg(F.count(F.lit(1)).alias("n"), *(a for _, _, some in rows for a in some))
    part = [F.struct(F.lit(name).alias("name"), F.lit(int(i)).alias("place"), F.col("n"), F.col(f"m{i}").alias("missing"), F.col(f"f{i}").alias("non_finite"), F.col(f"c{i}").alias("constant"), F.col(f"e{i}").alias("equal_target"), F.col(f"b{i}").alias("both"), F.col(f"p{i}").cast("string").alias("fingerprint")) for name, i, _ in rows]
    return one.select(F.inline(F.array(*part)))


def _named(rows: DataFrame, check: str, severity: str) -> DataFrame:
    """One row: how many columns, and which, in order."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",")
    return rows.agg(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.count(F.lit(1)).alias("n"), names.alias("names"))


def _counted(rows: DataFrame, check: str, severity: str, n: Column) -> DataFrame:
    return rows.agg(F.lit(check).alias("check"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n"), F.lit("").alias("names"))


def preflight(df: DataFrame, key: str, target: str, predictors: list[str], lat: str, lon: str, group: str, folds: int) -> DataFrame:
    """check, severity, n, names: a row for each check, passed ones with n = 0. Of columns: leaking (the target's name, or its every value),
    identifiers, repeated_names (but for case and outer blanks), repeated_content, all_missing, constant. Of rows: target_not_finite, coordinates
    (missing or out of range), groups (too few for the folds), repeated_rows (predictors and target), repeated_places."""
    plain = lambda c: F.lower(F.trim(c))
    cols = settled(profile(df, key, predictors, target), "column-profile")
    name = plain(F.col("name"))
    empty = F.col("missing") == F.col("n")
    leaks = (name == target.strip().lower()) | (F.col("both") > 0) & (F.col("equal_target") == F.col("both"))
    repeated = lambda by: cols.where(~empty).groupBy(by.alias("__by")).agg(F.min("place").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    later = lambda by: cols.where(~empty).join(F.broadcast(repeated(by)), by == F.col("__by")).where(F.col("place") > F.col("__first"))
    same_name = cols.groupBy(name.alias("__by")).agg(F.min("place").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    named = [
        _named(cols.where(leaks), "leaking", "error"),
        _named(cols.where(name.isin(*IDENTIFIERS)), "identifiers", "error"),
        _named(cols.join(F.broadcast(same_name), name == F.col("__by")).where(F.col("place") > F.col("__first")), "repeated_names", "error"),
        _named(later(F.col("fingerprint")), "repeated_content", "warning"),
        _named(cols.where(empty), "all_missing", "error"),
        _named(cols.where(~empty & F.col("constant")), "constant", "warning"),
    ]
    t = F.col(f"`{target}`")
    place = F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180), F.lit(False))
    shapes = df.groupBy(*(F.col(f"`{x}`") for x in dict.fromkeys([*predictors, target]))).agg(F.count(F.lit(1)).alias("__n"))
    places = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(F.count(F.lit(1)).alias("__n"))
    counted = [
        _counted(df, "target_not_finite", "error", F.count_if(t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")))),
        _counted(df, "coordinates", "error", F.count_if(~place)),
        _counted(df.where(place), "groups", "error", F.greatest(F.lit(0), F.lit(folds) - F.countDistinct(group))),
        _counted(shapes, "repeated_rows", "warning", F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))),
        _counted(places, "repeated_places", "warning", F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))),
    ]
    out = named[0]
    for x in [*named[1:], *counted]:
        out = out.unionByName(x)
    return out


def contract(df: DataFrame, sample: str, path: str, group: str, lat: str, lon: str, value: str, verification: str, source: str, cut: float) -> DataFrame:
    """sample, site, patch, status, label, site_labels and problems of every row of a sample manifest; a column that isn't there is an error.
    problems, comma-joined: no_id, repeated_id (blanks around ids don't count), no_path, no_group, not_finite, out_of_range, negative. label: high where
    value reaches cut, else low; site_labels: mixed where the site's rows without problems have both labels, else one_label; null for rows with problems."""
    absent = sorted({sample, path, group, lat, lon, value, verification, source} - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = finite(lat) & finite(lon) & finite(value)
    rows = df.withColumn("__id", F.when(~blank(sample), F.trim(F.col(sample).cast("string"))))
    often = rows.where("__id is not null").groupBy(F.col("__id").alias("__often")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    rows = rows.join(often, F.col("__id") == F.col("__often"), "left")
    found = {"no_id": F.col("__id").isNull(), "repeated_id": F.col("__often").isNotNull(), "no_path": blank(path), "no_group": blank(group), "not_finite": ~whole,
             "out_of_range": whole & ((F.abs(lat) > 90) | (F.abs(lon) > 180)), "negative": whole & (F.col(value) < 0)}
    problems = F.array_join(F.array_compact(F.array(*(F.when(bad, name) for name, bad in found.items()))), ",")
    out = rows.select(F.col(sample).alias("sample"), F.when(whole, c.site_id(lat, lon)).alias("site"), c.path_id(path).alias("patch"), c.eligibility(verification, source).alias("status"), F.when(whole & (F.col(value) >= cut), "high").when(whole, "low").alias("label"), problems.alias("problems"))
    out = settled(out, "contract")
    sites = out.where("problems = ''").groupBy(F.col("site").alias("__site")).agg((F.min("label") != F.max("label")).alias("mixed"))
    return out.join(sites, F.col("site") == F.col("__site"), "left").select("sample", "site", "patch", "status", "label", F.when((F.col("problems") == "") & F.col("mixed"), "mixed").when(F.col("problems") == "", "one_label").alias("site_labels"), "problems")


def passed(checks: DataFrame) -> None:
    """An error unless all checks of that severity found nothing."""
    assert_empty(checks.where("severity = 'error' and n > 0"), "the preflight found errors")
