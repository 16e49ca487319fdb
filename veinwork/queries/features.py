"""Queries of image feature vectors, every column against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import features as x
from veinwork.operators import joins as j
from veinwork.operators.raster import BANDS
from veinwork.sources.scratch import settled

from .raster import ALL
from .registry import query

CELL = "'g_' || floor((lat + 90) / 0.5e0)::bigint || '_' || floor((lon + 180) / 0.5e0)::bigint"
#: Every 17th value is missing in the base bands, every 29th in the added ones.
GAP, ADDED_GAP = 17, 29
WIDTH = 8
_STATS = "coalesce(avg(v), 0) as mean, coalesce(stddev_pop(v), 0) as std, coalesce(quantile_cont(v, 0.1), 0) as p10, coalesce(quantile_cont(v, 0.5), 0) as p50, coalesce(quantile_cont(v, 0.9), 0) as p90, coalesce(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0) as iqr"


def _steps(source: str) -> str:
    one = lambda a, b: f"select image_id, band, abs(v - lag(v) over (partition by image_id, band, {a} order by {b})) as d from {source}"
    return f"select image_id, band, coalesce(avg(d), 0) as texture_mean, coalesce(quantile_cont(d, 0.9), 0) as texture_p90 from ({one('x', 'y')} union all {one('y', 'x')}) group by 1, 2"


def _pixels(names: list[str], gap: int, first: int, bands: int) -> str:
    """CTE body: pixels of the bands `first` and on of images of so many bands."""
    return f"""select vec_id // {bands} as image_id, {names}[vec_id % {bands} - {first} + 1] as band, ((i - 1) // {WIDTH})::int as y, ((i - 1) % {WIDTH})::int as x, case when (vec_id + i - 1) % {gap} <> 0 then embedding[i]::double end as v
    from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from pixels where vec_id // {bands} in (select vec_id // {bands} from pixels group by 1 having count(distinct vec_id % {bands}) = {bands})) where vec_id % {bands} between {first} and {first + len(names) - 1}"""


def base_sql(bands: int) -> str:
    """CTEs up to bv: image_id and the 126 features."""
    wide = ", ".join(f"max(v) filter (band = '{b}') as {b}" for b in BANDS)
    index = " union all ".join(f"select image_id, '{k}' as band, {e} as v from b6" for k, e in ALL.items())
    cols = [f"max({s}) filter (band = '{b}') as {b}_{s}" for b in [*BANDS, *x.INDICES] for s in x.STATISTICS]
    texture = [f"max({s}) filter (band = '{b}') as {b}_{s}" for b in BANDS for s in x.TEXTURE]
    return f"""b0 as ({_pixels(BANDS, GAP, 0, bands)}), bm as (select image_id, band, median(v) as m from b0 group by 1, 2), bp as (select image_id, band, y, x, coalesce(v, m, 0) as v from b0 join bm using (image_id, band)), b6 as (select image_id, y, x, {wide} from bp group by 1, 2, 3),
    bs as (select image_id, band, {_STATS} from (select image_id, band, v from bp union all {index}) group by 1, 2), bt as ({_steps('bp')}), bv as (select * from (select image_id, {', '.join(cols)} from bs group by 1) join (select image_id, {', '.join(texture)} from bt group by 1) using (image_id))"""


def rededge_sql(bands: int, first: int) -> str:
    """CTEs up to rv: image_id, the 44 features (null below half coverage), coverage."""
    nd = lambda a, b: f"case when abs({a} + {b}) > 1e-6 then ({a} - {b}) / ({a} + {b}) end"
    index = f"select image_id, 'ndre1' as band, {nd('nir08', 'rededge1')} as v from r4 union all select image_id, 'ndre2', {nd('rededge3', 'rededge2')} from r4"
    wide = ", ".join(f"max(v) filter (band = '{b}') as {b}" for b in x.REDEDGE)
    cols = [f"max({s}) filter (band = '{b}') as {b}_refl_{s}" for b in [*x.REDEDGE, "ndre1", "ndre2"] for s in x.STATISTICS]
    texture = [f"max({s}) filter (band = '{b}') as {b}_refl_{s}" for b in x.REDEDGE for s in x.TEXTURE]
    kept = ", ".join(f"case when coverage >= 0.5e0 then {n} end as {n}" for n in x.REDEDGE_NAMES)
    return f"""r0 as ({_pixels(x.REDEDGE, ADDED_GAP, first, bands)}), ro as (select image_id, y, x, count(v) = {len(x.REDEDGE)} as ok from r0 group by 1, 2, 3), rc as (select image_id, avg(ok::int) as coverage from ro group by 1), rp as (select image_id, band, y, x, case when ok then v end as v from r0 join ro using (image_id, y, x)), r4 as (select image_id, y, x, {wide} from rp group by 1, 2, 3),
    rs as (select image_id, band, {_STATS} from (select image_id, band, v from rp union all {index}) group by 1, 2), rt as ({_steps('rp')}), rw as (select * from (select image_id, {', '.join(cols)} from rs group by 1) join (select image_id, {', '.join(texture)} from rt group by 1) using (image_id) join rc using (image_id)), rv as (select image_id, {kept}, coverage from rw)"""


def _images(pixels, bands: int, first: int, n: int):
    step = F.when(F.col("vec_id") % bands < len(BANDS) if bands != len(x.REDEDGE) else F.lit(False), F.lit(GAP)).otherwise(F.lit(ADDED_GAP))
    values = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % step != 0, v.cast("double")))
    return x.images(pixels, F.floor(F.col("vec_id") / bands), F.col("vec_id") % bands - first, values, n)


@query("i05_feature_vector", "pixels geo", f"with {base_sql(6)} select bv.*, li, {CELL} as cell from bv join geo on geo.sample_id = bv.image_id")
def i05(pixels, geo):
    """The training set: 126 features of each image, its sample's lithium and spatial cell."""
    samples = geo.select(F.col("sample_id").alias("image_id"), "li", c.cell("lat", "lon").alias("cell"))
    return j.one_to_one(x.base_vectors(_images(pixels, 6, 0, 6), WIDTH), samples, ["image_id"])


@query("i08_append_features", "pixels", f"with {rededge_sql(4, 0)} select * from rv")
def i08(pixels):
    """The 44 red-edge features from jointly valid pixels; images of too little coverage are abstained from."""
    return x.rededge_vectors(_images(pixels, 4, 0, 4), WIDTH)


@query("n24_feature_assembly", "pixels", f"with {base_sql(10)}, {rededge_sql(10, 6)} select * from bv join rv using (image_id)")
def n24(pixels):
    """126 and 44 features of images of ten bands, in one pass."""
    return x.appended(_images(pixels, 10, 0, 10), WIDTH)


_H = "md5('im|' || scenario || '|' || image_id || '|' || b || '|' || i)"
_Z = f"sqrt(-2 * ln((('0x' || substr({_H}, 1, 8))::bigint + 0.5e0) / 4294967296e0)) * cos(('0x' || substr({_H}, 9, 8))::bigint * (2 * pi() / 4294967296e0))"
_SHAKEN = f"""ip as (select vec_id // 6 as image_id, (vec_id % 6)::int as b, i - 1 as i, embedding[i]::double as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from pixels where vec_id // 6 in (select vec_id // 6 from pixels group by 1 having count(distinct vec_id % 6) = 6))),
    sd as (select image_id, b, stddev_pop(v) as s from ip group by 1, 2), sc(scenario, kind, p) as (values {', '.join(f"('{n}', '{k}', {p}::double)" for n, k, p in x.SCENARIOS)}),
    sh as (select image_id, scenario, b, i, case kind when 'missing_pixels' then case when ('0x' || substr({_H}, 1, 8))::bigint / 4294967296e0 >= p then v end when 'noise' then v + {_Z} * s * p when 'band_missing' then case when b <> p::int then v end when 'brightness' then v * p else v end as v from ip join sd using (image_id, b), sc),
    fm as (select image_id, scenario, b, median(v) as m from sh group by all), ff as (select image_id, scenario, b, i, coalesce(v, m, 0) as v from sh join fm using (image_id, scenario, b)), nd as (select image_id, scenario, i, max(v) filter (b = 3) as n, max(v) filter (b = 0) as r from ff group by all),
    g as (select image_id, scenario, avg(n) as nir_mean, stddev_pop(n) as nir_std, quantile_cont(case when abs(n + r) > 1e-6 then (n - r) / (n + r) else 0 end, 0.5) as ndvi_p50 from nd group by all), h as (select image_id, scenario, avg((v is null)::int) as missing from sh group by all)"""


@query("i14_image_perturbation", "pixels", f"with {_SHAKEN} select g.image_id, g.scenario, missing, missing > 0.5e0 as abstain, g.nir_mean, g.nir_std, g.ndvi_p50, g.ndvi_p50 - o.ndvi_p50 as ndvi_shift from g join h using (image_id, scenario) join g o on o.image_id = g.image_id and o.scenario = 'baseline'")
def i14(pixels):
    """Features of every image under every scenario, and how far they move."""
    images = x.images(pixels, F.floor(F.col("vec_id") / 6), F.col("vec_id") % 6, F.col("embedding"), 6)
    rows = x.perturbed(images).select(F.concat_ws("|", F.col("image_id").cast("string"), "scenario").alias("image_id"), "bands")
    rows = settled(rows, "perturbed")
    part = lambda i: F.split("image_id", "[|]")[i]
    features = x.base_vectors(rows, WIDTH).join(rows.select("image_id", x.missing_share(F.col("bands")).alias("missing")), "image_id")
    features = settled(features.select(part(0).cast("bigint").alias("image_id"), part(1).alias("scenario"), "missing", (F.col("missing") > 0.5).alias("abstain"), "nir_mean", "nir_std", "ndvi_p50"), "perturbed-features")
    base = features.where("scenario = 'baseline'").select("image_id", F.col("ndvi_p50").alias("__base"))
    return features.join(base, "image_id").withColumn("ndvi_shift", F.col("ndvi_p50") - F.col("__base")).drop("__base")
