"""Features of pixel tables (image_id, band, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band names, and sums that count as nothing.
BANDS = ["red", "green", "blue", "nir", "swir16", "swir22"]
SMALL = 1e-6


def pixels(df: DataFrame, key: str, values: str, width: int = 8) -> DataFrame:
    """A pixel table from one array per row: BANDS rows make an image; images with fewer bands drop out."""
    n = len(BANDS)
    band = F.get(F.array(*map(F.lit, BANDS)), (F.col(key) % n).cast("int"))
    long = df.select(F.floor(F.col(key) / n).alias("image_id"), band.alias("band"), F.posexplode(values).alias("i", "v"))
    whole = df.groupBy(F.floor(F.col(key) / n).alias("image_id")).agg(F.countDistinct(F.col(key) % n).alias("c")).where(F.col("c") == n)
    v = F.col("v").cast("double")
    return long.join(whole.select("image_id"), "image_id", "left_semi").select("image_id", "band", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), v.alias("v"))


def filled(px: DataFrame) -> DataFrame:
    """Non-finite values take the band's median in the image, 0 where it has none."""
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    medians = px.groupBy("image_id", "band").agg(F.median(finite).alias("__m"))
    return px.join(medians, ["image_id", "band"]).withColumn("v", F.coalesce(finite, "__m", F.lit(0.0))).drop("__m")


def standardised(px: DataFrame) -> DataFrame:
    s = px.groupBy("image_id", "band").agg(F.avg("v").alias("__a"), F.stddev_pop("v").alias("__s"))
    return px.join(s, ["image_id", "band"]).withColumn("v", F.when(F.col("__s") > SMALL, (F.col("v") - F.col("__a")) / F.col("__s")).otherwise(F.lit(0.0))).drop("__a", "__s")


def summary(px: DataFrame, keys: list[str]) -> DataFrame:
    p = F.percentile("v", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = px.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), p.alias("p"))
    return g.select(*keys, "mean", "std", F.col("p")[0].alias("p10"), F.col("p")[2].alias("p50"), F.col("p")[4].alias("p90"), (F.col("p")[3] - F.col("p")[1]).alias("iqr"))


def texture(px: DataFrame) -> DataFrame:
    """Mean and 90th percentile of the steps between neighbours along both axes."""
    down, across = Window.partitionBy("image_id", "band", "x").orderBy("y"), Window.partitionBy("image_id", "band", "y").orderBy("x")
    both = px.withColumn("__d", F.abs(F.col("v") - F.lag("v").over(down))).withColumn("__a", F.abs(F.col("v") - F.lag("v").over(across)))
    steps = both.select("image_id", "band", F.explode(F.array_compact(F.array("__d", "__a"))).alias("d"))
    return steps.groupBy("image_id", "band").agg(F.avg("d").alias("texture_mean"), F.percentile("d", F.lit(0.9)).alias("texture_p90"))


def wide(px: DataFrame) -> DataFrame:
    """A row per pixel, a column per band."""
    return px.groupBy("image_id", "y", "x").agg(*(F.max(F.when(F.col("band") == b, F.col("v"))).alias(b) for b in BANDS))


def _share(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > SMALL, a / b).otherwise(F.lit(0.0))


def indices() -> dict[str, Column]:
    r, g, b, n, s1, s2 = (F.col(x) for x in BANDS)
    nd = lambda x, y: _share(x - y, x + y)
    return {
        "ndvi": nd(n, r), "ndmi": nd(n, s1), "nbr": nd(n, s2), "nbr2": nd(s1, s2), "mndwi": nd(g, s1), "bare_soil_index": nd(s1 + r, n + b),
        "dry_bare_soil_index": nd(s1, g) - nd(n, r), "nir_swir22_nd": nd(n, s2), "red_swir16_nd": nd(r, s1), "swir16_swir22_ratio": _share(s1, s2),
        "nir_swir16_ratio": _share(n, s1), "red_blue_ratio": _share(r, b), "green_red_ratio": _share(g, r),
    }


def spectral(px: DataFrame) -> DataFrame:
    """summary() of every index of every image."""
    w = wide(px)
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("v")) for k, v in indices().items()))
    return summary(w.select("image_id", F.inline(rows)), ["image_id", "feature"])


def reflectance(px: DataFrame, scales: DataFrame) -> DataFrame:
    """v * scale + offset by band; null stays null. scales: (band, scale, offset), a row per band."""
    return px.join(F.broadcast(scales), "band", "left").withColumn("v", F.col("v") * F.col("scale") + F.col("offset")).drop("scale", "offset")


def valid_pixels(px: DataFrame) -> DataFrame:
    """The pixels with a value in every band."""
    ok = px.where(F.col("v").isNotNull()).groupBy("image_id", "y", "x").agg(F.countDistinct("band").alias("n")).where(F.col("n") == len(BANDS))
    return px.join(ok.drop("n"), ["image_id", "y", "x"], "left_semi")


def missingness(px: DataFrame, size: int = 8) -> DataFrame:
    """Share of valid values over all, the centre and the border of each image's band."""
    q = size // 4
    centre = F.col("y").between(q, size - q - 1) & F.col("x").between(q, size - q - 1)
    v = F.col("v").isNotNull().cast("double")
    return px.groupBy("image_id", "band").agg(F.avg(v).alias("valid"), F.avg(F.when(centre, v)).alias("valid_centre"), F.avg(F.when(~centre, v)).alias("valid_border"), F.min(F.when(F.col("v").isNull(), F.col("y"))).alias("first_gap_y"), F.max(F.when(F.col("v").isNull(), F.col("y"))).alias("last_gap_y"))


def centre(px: DataFrame, low: int, high: int) -> DataFrame:
    return px.where(F.col("y").between(low, high - 1) & F.col("x").between(low, high - 1))


def scene_classes(px: DataFrame, blocked: tuple[int, ...] = (0, 1, 3, 8, 9, 10), most: float = 0.2) -> DataFrame:
    """px: (image_id, class). Shares of blocked, class 5 and snow pixels, and the reasons against a scene."""
    g = px.groupBy("image_id").agg(F.count("class").alias("n"), F.avg(F.col("class").isin(*blocked).cast("double")).alias("blocked"), F.avg((F.col("class") == 5).cast("double")).alias("bare"), F.avg((F.col("class") == 11).cast("double")).alias("snow"))
    reasons = F.array_compact(F.array(F.when(F.col("blocked") > most, F.lit("blocked")), F.when(F.col("snow") > 0.1, F.lit("snow")), F.when(F.col("bare") == 0, F.lit("no_bare_soil"))))
    return g.withColumn("reasons", F.array_join(reasons, ","))


def signature_groups(features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, signature of the features, and how many rows share it."""
    from .windows import multiplicity

    signed = features.select(key, F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))).alias("signature"))
    return multiplicity(signed, ["signature"])
