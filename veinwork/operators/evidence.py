"""Audits of folds, links, releases and arms over the tables that studies are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.columns import haversine_km
from veinwork.operators import folds as f
from veinwork.operators import joins as j
from veinwork.operators import metrics as m
from veinwork.operators.windows import keep_first
from veinwork.sources.scratch import settled


def leaking(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature, same_name, equal_rows, leaks: features that are the target by name or by every value."""
    key = lambda x: x.strip().lower()
    t = F.col(target)
    one = df.where(t.isNotNull()).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"`{x}`") == t).alias(f"e_{i}") for i, x in enumerate(features)))
    rows = F.array(*(F.struct(F.lit(x).alias("feature"), F.lit(key(x) == key(target)).alias("same_name"), F.col(f"e_{i}").alias("equal_rows"), "n") for i, x in enumerate(features)))
    out = one.select(F.inline(rows))
    return out.select("feature", "same_name", "equal_rows", (F.col("same_name") | (F.col("n") > 0) & (F.col("equal_rows") == F.col("n"))).alias("leaks"))


def nearest_training(df: DataFrame, key: str, fold: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, distance_km of each row to the nearest row of another fold. Places and folds are counted once; at a place that several
    folds share the distance is nothing."""
    sites = settled(df.groupBy(lat, lon).agg(F.min(fold).alias("low"), F.max(fold).alias("high")), "sites")
    rows = df.join(sites, [lat, lon]).select(key, lat, lon, fold, "low", "high")
    at_home = rows.where("low <> high").select(key, F.lit(0.0).alias("distance_km"))
    alone = sites.where("low = high").select(F.concat_ws("|", lat, lon).alias("site"), lat, lon, F.col("low").alias("own"))
    other = df.select(F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"), F.col(fold).alias("r_fold")).distinct()
    far = [j.nearest(alone.where(F.col("own") == k), other.where(F.col("r_fold") != k).withColumn("r_site", F.concat_ws("|", "r_lat", "r_lon")), "site", "r_site") for k in sorted(r[0] for r in sites.select("low").distinct().collect())]
    back = reduce(DataFrame.unionByName, far).join(alone, "site").select(lat, lon, "distance_km")
    return at_home.unionByName(rows.where("low = high").join(back, [lat, lon]).select(key, "distance_km"))


def fold_audit(df: DataFrame, key: str, fold: str, group: str, shared: str, warn_km: float = 5.0) -> DataFrame:
    """fold, n_train, n_test, min_km, n_too_close, n_shared, n_mixed_groups: what test rows have near or in common with training rows."""
    near = nearest_training(df, key, fold)
    span = df.groupBy(shared).agg(F.min(fold).alias("a"), F.max(fold).alias("b"))
    mixed = df.groupBy(group).agg(F.min(fold).alias("c"), F.max(fold).alias("d"))
    rows = df.join(near, key).join(span, shared).join(mixed, group)
    per = rows.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_test"), F.min("distance_km").alias("min_km"), F.count_if(F.col("distance_km") < warn_km).alias("n_too_close"),
        F.count_if(F.col("a") != F.col("b")).alias("n_shared"), F.count_if(F.col("c") != F.col("d")).alias("n_mixed_groups"),
    )
    return per.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))


def stratified_group_folds(df: DataFrame, group: str, y: str, folds: int) -> DataFrame:
    """(group, fold): groups with most positives first, then the largest, each to the fold with fewest positives, then fewest rows,
    then the first. The dealing goes group by group over the table of groups (spatial cells: as many as the earth has)."""
    sizes = df.groupBy(group).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))

    def run(frames):
        load = [[0, 0, k] for k in range(folds)]
        for x in frames:
            out = []
            for p, n in zip(x["p"], x["n"], strict=True):
                best = min(load)
                out.append(best[2])
                best[0] += int(p)
                best[1] += int(n)
            yield x[[group]].assign(fold=out)

    kind = dict(df.dtypes)[group]
    return sizes.coalesce(1).sortWithinPartitions(F.desc("p"), F.desc("n"), group).mapInPandas(run, f"{group} {kind}, fold int")


def frozen_thresholds(df: DataFrame, folds: int, y: str = "y", score: str = "score", group: str = "cell", fold: str = "fold") -> DataFrame:
    """fold, threshold: chosen on the rows of the other folds alone. A group in several folds, scores outside 0 to 1, or training
    rows of one class are errors."""
    j.assert_empty(df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1"), "groups are split across folds")
    j.assert_empty(df.where(F.col(score).isNull() | ~F.col(score).between(0, 1)).select(score), "scores are not within 0 and 1")
    train = f.training_rows(df, folds, fold)
    j.assert_empty(train.groupBy("train_fold").agg(F.countDistinct(y).alias("classes")).where("classes < 2"), "training rows have one class")
    return m.operating_threshold(train, ["train_fold"], y, score).select(F.col("train_fold").alias("fold"), "threshold")


ARMS = ("all", "no_shared_scenes", "no_mixed_sites", "buffer_5km", "buffer_10km")


def arm_rows(df: DataFrame, folds: int, key: str, scene: str, site: str, label: str, fold: str = "fold", arms: tuple[str, ...] = ARMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(arm, train_fold, key, keep): the training rows of every declared arm. Only training rows, scenes and places of test rows decide.
    What a row must not train is a list of folds by scene, site or place; rows are joined once each and multiplied last."""
    rows = settled(df.select(*dict.fromkeys([key, fold, scene, site, label, "lat", "lon", *keep])), "arm-rows")
    every = F.array(*map(F.lit, range(folds)))
    others = F.array_except(every, F.array(F.col(fold).cast("int")))

    def arm(name: str, barred: DataFrame | None = None, on: tuple[str, ...] = ()) -> DataFrame:
        with_barred = rows.join(barred, list(on), "left") if barred is not None else rows.withColumn("__barred", F.lit(None))
        left = F.array_except(others, F.coalesce(F.col("__barred"), F.array().cast("array<int>")))
        return with_barred.select(F.lit(name).alias("arm"), F.explode(left).alias("train_fold"), key, *keep)

    out = [arm("all")] if "all" in arms else []
    if "no_shared_scenes" in arms:
        out.append(arm("no_shared_scenes", rows.where(F.col(scene).isNotNull()).groupBy(scene).agg(F.collect_set(F.col(fold).cast("int")).alias("__barred")), (scene,)))
    if "no_mixed_sites" in arms:
        # a site's labels differ among the rows outside a fold: from the least and the greatest label of each of its folds
        spans = rows.groupBy(site, fold).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).groupBy(site).agg(F.collect_list(F.struct(fold, "lo", "hi")).alias("__spans"))
        outside = lambda t: F.filter("__spans", lambda x: x[fold] != t)
        mixed = F.filter(every, lambda t: F.array_min(F.transform(outside(t), lambda x: x["lo"])) != F.array_max(F.transform(outside(t), lambda x: x["hi"])))
        out.append(arm("no_mixed_sites", spans.select(site, mixed.alias("__barred")), (site,)))
    places = rows.select("lat", "lon").distinct()
    tests = rows.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col(fold).cast("int").alias("train_fold")).distinct()
    for name, km in (("buffer_5km", 5.0), ("buffer_10km", 10.0)):
        if name in arms:
            near = j.radius_pairs(places, tests, km).groupBy("lat", "lon").agg(F.collect_set("train_fold").alias("__barred"))
            out.append(arm(name, near, ("lat", "lon")))
    return reduce(DataFrame.unionByName, out)


def quality_training_rows(df: DataFrame, folds: int, quality: Column, least: float = 0.95, fold: str = "fold") -> DataFrame:
    """Training rows whose quality is good enough; what tests a fold is never dropped."""
    return f.training_rows(df, folds, fold).where(F.coalesce(quality >= least, F.lit(False)))


def linked(left: DataFrame, right: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """left with its row of right (keys unique there): a flag for every check that fails on a linked row, and status: linked, unlinked or conflict."""
    both = j.many_to_one(left, right.withColumn("__hit", F.lit(True)), keys)
    for name, ok in checks.items():
        both = both.withColumn(name, F.col("__hit").isNotNull() & ~F.coalesce(ok, F.lit(False)))
    any_ = reduce(lambda a, b: a | b, (F.col(x) for x in checks))
    return both.withColumn("status", F.when(F.col("__hit").isNull(), "unlinked").when(any_, "conflict").otherwise("linked")).drop("__hit")


def author_overlap(left: Column, known: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """rows with overlap: UNKNOWN without an author-year key, overlap if known has it, else none."""
    seen = known.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    out = rows.join(seen, left == F.col("__k"), "left")
    return out.withColumn("overlap", F.when(left.isNull(), "UNKNOWN").when(F.col("__k").isNotNull(), "overlap").otherwise("none")).drop("__k")


def release_gate(evidence: DataFrame, policy: dict[str, float]) -> DataFrame:
    """evidence: a row per candidate with flags, counts and metrics. violations: in order, those that the policy names; a missing
    flag or metric is one. Passing isn't approval."""
    v = lambda x: F.col(x)
    checks = [
        ("source_not_independent", v("independent")), ("holdout_consulted", v("unconsulted")), ("possible_duplicates", v("duplicates") == 0), ("too_few_regions", v("regions") >= policy["regions"]),
        ("too_few_samples", v("n") >= policy["n"]), ("too_few_positives", v("positives") >= policy["positives"]), ("too_few_negatives", v("n") - v("positives") >= policy["negatives"]),
        ("auc_below_minimum", v("auc") >= policy["auc"]), ("auc_below_reference", v("auc") - v("reference_auc") >= policy["auc_gain"]), ("ap_regression", v("ap") - v("reference_ap") >= policy["ap_gain"]),
        ("calibration_regression", v("brier") - v("reference_brier") <= policy["brier_loss"]),
    ]
    named = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks)))
    return evidence.withColumn("violations", F.array_join(named, ",")).withColumn("evidence_passes", F.size(named) == 0)


def score_metrics(df: DataFrame, keys: list[str], score: str, y: str = "y") -> DataFrame:
    """keys, n, positives, auc, ap, brier."""
    c = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))
    return c.join(m.ranking(df, keys, y, score), keys)


def two_sided_pilot(df: DataFrame, value: str, threshold: float, cell: str, paper: str, order: list, limit: int) -> DataFrame:
    """A pilot of high and low rows in turn: the first row of each cell, then of each paper, then one high and one low after the other."""
    one = keep_first(keep_first(df.where(F.col(value).isNotNull()), [cell], order), [paper], order).withColumn("side", F.when(F.col(value) >= threshold, "high").otherwise("low"))
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy("side").orderBy(*order)))
    return turn.orderBy("turn", "side").limit(limit)


def apart_pilot(df: DataFrame, ref: str, order: list, km: float, limit: int) -> DataFrame:
    """Up to limit rows in order, no two of one ref or at most km apart: one after the other, each from what the ones before leave."""
    left, picked = settled(df.withColumn("__o", F.struct(*order)), "pilot"), []
    for _ in range(limit):
        first = left.orderBy("__o").limit(1).collect()
        if not first:
            break
        r = first[0]
        picked.append(r)
        left = left.where((F.col(ref) != r[ref]) & (haversine_km(F.col("lat"), F.col("lon"), F.lit(r["lat"]), F.lit(r["lon"])) > km))
    return df.sparkSession.createDataFrame(picked, left.schema).drop("__o")


def common_rows(arms: DataFrame, key: str, arm: str, y: str, fold: str) -> DataFrame:
    """The rows that every arm has; one row with two labels or folds is an error."""
    j.assert_empty(arms.groupBy(key).agg(F.countDistinct(y).alias("labels"), F.countDistinct(fold).alias("folds")).where("labels > 1 or folds > 1"), "arms disagree on labels or folds")
    n = arms.select(arm).distinct().count()
    return arms.join(arms.groupBy(key).agg(F.countDistinct(arm).alias("__n")).where(F.col("__n") == n).select(key), key, "left_semi")


def patch_quality(px: DataFrame, valid: Column, least: float = 0.95, size: int = 8) -> DataFrame:
    """image_id, joint_valid (pixels valid in all bands), low_coverage, ndvi_p50, green_share (NDVI over 0.4), centre_shift (red mean of
    the centre less that of the whole), integrity."""
    ok = px.withColumn("ok", valid)
    # a row for every pixel with the bands that the indices ask for
    wide = ok.groupBy("image_id", "y", "x").agg(F.bool_and("ok").alias("ok"), *(F.max(F.when(F.col("band") == b, F.col("v"))).alias(b) for b in ("red", "nir")))
    sum_ = F.col("nir") + F.col("red")
    ndvi = F.when(F.col("ok") & (F.abs(sum_) > 1e-6), (F.col("nir") - F.col("red")) / sum_)
    centre = F.col("y").between(size // 4, size - size // 4 - 1) & F.col("x").between(size // 4, size - size // 4 - 1)
    g = wide.withColumn("ndvi", ndvi).groupBy("image_id").agg(
        F.avg(F.col("ok").cast("int")).alias("joint_valid"), F.median("ndvi").alias("ndvi_p50"), F.avg((F.col("ndvi") > 0.4).cast("int")).alias("green_share"),
        (F.avg(F.when(centre, F.col("red"))) - F.avg("red")).alias("centre_shift"),
    )
    low = F.col("joint_valid") < least
    return g.withColumn("low_coverage", low).withColumn("integrity", F.when(F.col("joint_valid") == 0, "empty").when(low, "partial").otherwise("complete"))


def rate_calibrated(df: DataFrame, folds: int, y: str = "y", score: str = "score", fold: str = "fold") -> DataFrame:
    """df with each score replaced by its rate of positives in the other folds; a score that they lack takes their overall rate."""
    counts = df.groupBy(F.col(fold).alias("fold"), F.col(score).alias("__s")).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"))
    train = f.training_rows(counts, folds).groupBy(F.col("train_fold").alias("__f"), "__s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rate = train.select("__f", "__s", (F.col("p") / F.col("n")).alias("__r"))
    rest = train.groupBy("__f").agg((F.sum("p") / F.sum("n")).alias("__all"))
    out = df.join(rate, (F.col(fold) == F.col("__f")) & (F.col(score) == F.col("__s")), "left").drop("__f", "__s").join(F.broadcast(rest), F.col(fold) == F.col("__f"))
    return out.withColumn(score, F.coalesce("__r", "__all")).select(*df.columns)
