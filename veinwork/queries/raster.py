"""Queries of pixel-table features."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.operators import raster as r

from .registry import query

PX = """w as (select vec_id // 6 as image_id from pixels group by 1 having count(distinct vec_id % 6) = 6), px as (select vec_id // 6 as image_id, ['red', 'green', 'blue', 'nir', 'swir16', 'swir22'][vec_id % 6 + 1] as band, ((i - 1) // 8)::int as y, ((i - 1) % 8)::int as x, embedding[i]::double as v
    from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from pixels) where vec_id // 6 in (select image_id from w))"""
STATS = "round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.9), 6) as p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as iqr"
IDX = {
    "ndvi": ("nir", "red"), "ndmi": ("nir", "swir16"), "nbr": ("nir", "swir22"), "nbr2": ("swir16", "swir22"), "mndwi": ("green", "swir16"), "bare_soil_index": ("(swir16 + red)", "(nir + blue)"),
    "nir_swir22_nd": ("nir", "swir22"), "red_swir16_nd": ("red", "swir16"),
}


def _nd(a: str, b: str) -> str:
    return f"case when abs({a} + {b}) > 1e-6 then ({a} - {b}) / ({a} + {b}) else 0 end"


def _ratio(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-6 then {a} / {b} else 0 end"


ALL = {k: _nd(*v) for k, v in IDX.items()} | {"dry_bare_soil_index": f"{_nd('swir16', 'green')} - {_nd('nir', 'red')}"} | {f"{a}_{b}_ratio": _ratio(a, b) for a, b in (("swir16", "swir22"), ("nir", "swir16"), ("red", "blue"), ("green", "red"))}


def _px(df):
    return r.pixels(df, "vec_id", "embedding")


@query("i01_fill_standardise", "pixels", f"with {PX}, s as (select image_id, band, avg(v) as a, stddev_pop(v) as s from px group by 1, 2) select image_id, band, y, x, round(case when s > 1e-6 then (v - a) / s else 0 end, 6) as v from px join s using (image_id, band)")
def i01(df):
    return r.standardised(r.filled(_px(df))).select("image_id", "band", "y", "x", "v")


@query("i02_band_summary", "pixels", f"with {PX} select image_id, band, {STATS} from px group by 1, 2")
def i02(df):
    return r.summary(_px(df), ["image_id", "band"])


@query("i03_texture", "pixels", f"with {PX}, d as (select image_id, band, abs(v - lag(v) over (partition by image_id, band, x order by y)) as d from px union all select image_id, band, abs(v - lag(v) over (partition by image_id, band, y order by x)) from px) select image_id, band, round(avg(d), 6) as texture_mean, round(quantile_cont(d, 0.9), 6) as texture_p90 from d where d is not null group by 1, 2")
def i03(df):
    return r.texture(_px(df))


@query("i04_spectral_indices", "pixels", f"with {PX}, w6 as (select image_id, y, x, " + ", ".join(f"max(v) filter (band = '{b}') as {b}" for b in r.BANDS) + " from px group by 1, 2, 3), f as (" + " union all ".join(f"select image_id, '{k}' as feature, {v} as v from w6" for k, v in ALL.items()) + f") select image_id, feature, {STATS.replace('6) as', '4) as')} from f group by 1, 2")
def i04(df):
    s = r.spectral(_px(df))
    return s.select("image_id", "feature", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p90", "iqr")))


@query("i06_reflectance", "pixels", f"with {PX} select image_id, band, round(avg(v * case band when 'red' then 0.5e0 when 'nir' then 2e0 end + 0.1e0), 6) as v from px where band in ('red', 'nir') group by 1, 2")
def i06(df):
    scales = df.sparkSession.createDataFrame([("red", 0.5, 0.1), ("nir", 2.0, 0.1)], "band string, scale double, offset double")
    return r.reflectance(_px(df), scales).where("v is not null").groupBy("image_id", "band").agg(F.avg("v").alias("v"))


@query("i07_valid_pixels", "pixels", f"with {PX}, m as (select image_id, y, x from px group by 1, 2, 3 having count(*) filter (v > -0.5e0) = 6) select image_id, band, {STATS} from px join m using (image_id, y, x) group by 1, 2")
def i07(df):
    return r.summary(r.valid_pixels(_px(df).withColumn("v", F.when(F.col("v") > -0.5, F.col("v")))), ["image_id", "band"])


@query("i09_scene_classes", "pixels", f"""with {PX}, c as (select image_id, floor(abs(v) * 10)::int % 12 as k from px where band = 'red'), g as (select image_id, count(*) as n, avg((k in (0, 1, 3, 8, 9, 10))::int) as blocked, avg((k = 5)::int) as bare, avg((k = 11)::int) as snow from c group by 1)
    select image_id, n, round(blocked, 6) as blocked, round(bare, 6) as bare, round(snow, 6) as snow, array_to_string(list_filter([case when blocked > 0.2e0 then 'blocked' end, case when snow > 0.1e0 then 'snow' end, case when bare = 0 then 'no_bare_soil' end], lambda z: z is not null), ',') as reasons from g""")
def i09(df):
    return r.scene_classes(_px(df).where("band = 'red'").select("image_id", (F.floor(F.abs("v") * 10) % 12).cast("int").alias("class")))


@query("i10_missingness", "pixels", f"with {PX}, m as (select image_id, band, y, x, case when v > 0 then v end as v from px) select image_id, band, avg((v is not null)::int) as valid, avg((v is not null)::int) filter (y between 2 and 5 and x between 2 and 5) as valid_centre, round(avg((v is not null)::int) filter (not (y between 2 and 5 and x between 2 and 5)), 6) as valid_border, min(y) filter (v is null) as first_gap_y, max(y) filter (v is null) as last_gap_y from m group by 1, 2")
def i10(df):
    return r.missingness(_px(df).withColumn("v", F.when(F.col("v") > 0, F.col("v"))))


@query("i13_centre_window", "pixels", f"with {PX} select image_id, band, {STATS} from px where y between 2 and 5 and x between 2 and 5 group by 1, 2")
def i13(df):
    return r.summary(r.centre(_px(df), 2, 6), ["image_id", "band"])


@query("i15_signature_groups", "pixels", "select vec_id, count(*) over (partition by round(embedding[1], 1)) as n_same from pixels")
def i15(df):
    return r.signature_groups(df.select("vec_id", F.round(F.get("embedding", F.lit(0)), 1).alias("f")), "vec_id", ["f"]).select("vec_id", "n_same")


@query("i16_range_flags", "pixels", f"with {PX} select image_id, band, quantile_cont(v, 0.9) > 1 as high, quantile_cont(v, 0.1) < -1 as low from px group by 1, 2")
def i16(df):
    return r.summary(_px(df), ["image_id", "band"]).select("image_id", "band", (F.col("p90") > 1).alias("high"), (F.col("p10") < -1).alias("low"))
