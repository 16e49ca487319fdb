"""Queries of audits, links, arms, gates and studies over evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import aggregates as a
from veinwork.operators import decisions as d
from veinwork.operators import evidence as e
from veinwork.operators import folds as f
from veinwork.operators import joins as j
from veinwork.operators import metrics as m
from veinwork.operators import raster as r
from veinwork.operators import windows as w
from veinwork.operators.ordered import quantiles, with_quantiles
from veinwork.sources import tables as t
from veinwork.sources.scratch import folder

from .joins import HAV
from .raster import PX
from .registry import query

CELL = "'g_' || floor((lat + 90) / 0.5e0)::bigint || '_' || floor((lon + 180) / 0.5e0)::bigint"


def rank_sql(name: str, key: str, score: str, source: str) -> str:
    """CTEs up to `name`: key, auc, ap of a score."""
    above = f"over (partition by {key} order by s desc rows between unbounded preceding and 1 preceding)"
    return f"""{name}_d as (select {key}, {score} as s, sum(y) as p, count(*) - sum(y) as q from {source} where {score} is not null group by all),
    {name}_z as (select *, coalesce(sum(p) {above}, 0) as pa, coalesce(sum(q) {above}, 0) as qa from {name}_d),
    {name} as (select {key}, case when sum(p) > 0 and sum(q) > 0 then sum(q * (pa + p / 2)) / (sum(p) * sum(q)) end as auc, case when sum(p) > 0 and sum(q) > 0 then sum(p * (pa + p) / (pa + p + qa + q)) / sum(p) end as ap from {name}_z group by {key})"""


@query("c09_candidate_extraction", "export", r"select id, try_cast(li as double) as li from export where regexp_matches(upper(material), '\bWR\b|WHOLE ROCK') and try_cast(li as double) >= 0 and try_cast(lon_min as double) is not null and try_cast(lat_min as double) is not null")
def c09(export):
    ok = F.col("material").rlike(r"(?i)\bWR\b|WHOLE ROCK") & (c.number("li") >= 0) & c.number("lon_min").isNotNull() & c.number("lat_min").isNotNull()
    return export.where(ok).select("id", c.number("li").alias("li"))


@query("c10_train_only_quality", "oof", "select k.f::int as train_fold, count(*) filter (fold <> k.f) as all_train, count(*) filter (fold <> k.f and 1e0 - (sample_id % 25) / 100e0 >= 0.95e0) as kept_train, count(*) filter (fold = k.f) as tested from oof, range(5) k(f) group by 1")
def c10(oof):
    good = e.quality_training_rows(oof, 5, 1.0 - (F.col("sample_id") % 25) / 100.0).groupBy("train_fold").agg(F.count(F.lit(1)).alias("kept_train"))
    every = f.training_rows(oof, 5).groupBy("train_fold").agg(F.count(F.lit(1)).alias("all_train"))
    tests = oof.groupBy(F.col("fold").alias("train_fold")).agg(F.count(F.lit(1)).alias("tested"))
    return every.join(good, "train_fold").join(tests, "train_fold")


@query("c12_feature_policy", "pixels", f"with {PX} select image_id, " + ", ".join(f"avg(v) filter (band = '{b}') as {b}_mean" for b in r.BANDS) + " from px group by 1")
def c12(df):
    s = r.summary(r.pixels(df, "vec_id", "embedding"), ["image_id", "band"])
    both = s.groupBy("image_id").agg(*(F.max(F.when(F.col("band") == b, F.col(k))).alias(f"{b}_{k}") for b in r.BANDS for k in ("mean", "p50")))
    return both.select("image_id", *(x for x in both.columns if x.endswith("_mean")))


@query("d03_extended_screen", "oxides raw", "select sample_id, 'title of ' || location as title from oxides join raw on id = sample_id")
def d03(oxides, raw):
    keys = ["file", "name", "lat", "lon", "li_key"]
    side = lambda df: df.select(F.col("source").alias("file"), F.col("sample_id").cast("string").alias("name"), "lat", "lon", F.coalesce("li", F.lit(-1.0)).alias("li_key"), "sample_id")
    titles = side(oxides).drop("sample_id").join(raw.select(F.col("id").cast("string").alias("name"), F.concat(F.lit("title of "), "location").alias("title")), "name")
    out = j.many_to_one(side(oxides), titles, keys)
    j.assert_empty(out.where("title is null").select("sample_id"), "samples without a source record")
    return out.select("sample_id", "title")


@query("d05_link_consistency", "oxides geo", """with g as (select sample_id, lat as g_lat, li as g_li, source as g_source from geo) select sample_id, g_lat is not null and not coalesce(abs(lat - g_lat) <= 5e0, false) as far_apart, g_lat is not null and not coalesce(abs(li - g_li) <= 20e0, false) as other_value, g_lat is not null and g_source = 'click' as not_queued,
    case when g_lat is null then 'unlinked' when not coalesce(abs(lat - g_lat) <= 5e0, false) or not coalesce(abs(li - g_li) <= 20e0, false) or g_source = 'click' then 'conflict' else 'linked' end as status from oxides left join g using (sample_id)""")
def d05(oxides, geo):
    g = geo.select("sample_id", F.col("lat").alias("g_lat"), F.col("li").alias("g_li"), F.col("source").alias("g_source"))
    checks = {"far_apart": F.abs(F.col("lat") - F.col("g_lat")) <= 5.0, "other_value": F.abs(F.col("li") - F.col("g_li")) <= 20.0, "not_queued": F.col("g_source") != "click"}
    return e.linked(oxides, g, ["sample_id"], checks).select("sample_id", *checks, "status")


_KEY = r"regexp_replace(lower(regexp_replace(sample_name, '\[\d+\]', '', 'g')), '[^a-z0-9]', '', 'g')"


@query("d06_value_crosswalk", "raw", f"with k as (select id, {_KEY} as key from raw), p as (select key, max(id) as main from k group by 1) select id, main from k join p using (key) where abs(id - main) <= 10e0 + 0.05e0 * abs(main)")
def d06(raw):
    k = raw.select("id", c.name_key("sample_name").alias("key"))
    main = k.groupBy("key").agg(F.max("id").alias("main"))
    return j.within_tolerance(k, main, ["key"], {"id": "main"}, 10.0, 0.05).select("id", "main")


@query("d16_chained_links", "oof geo", "with p as (select publication, count(*) as n_pub from geo group by 1) select o.sample_id, o.fine, g.lat, p.n_pub from oof o left join geo g using (sample_id) left join p using (publication)")
def d16(oof, geo):
    pubs = geo.groupBy("publication").agg(F.count(F.lit(1)).alias("n_pub"))
    one = j.many_to_one(oof.select("sample_id", "fine"), geo.select("sample_id", "lat", "publication"), ["sample_id"])
    return j.many_to_one(one, pubs, ["publication"]).select("sample_id", "fine", "lat", "n_pub")


@query("d17_scene_inventory", "scen", "with i as (select region, year, count(*) filter (score is null) / count(*) as nodata from scen group by 1, 2) select id, nodata, nodata > 0.1e0 as flagged from scen left join i using (region, year)")
def d17(scen):
    inventory = scen.groupBy("region", "year").agg((F.count_if(F.col("score").isNull()) / F.count(F.lit(1))).alias("nodata"))
    return j.many_to_one(scen, inventory, ["region", "year"]).select("id", "nodata", (F.col("nodata") > 0.1).alias("flagged"))


_AY = r"case when rock is null then null else 'smith|' || regexp_extract(citation, '\b((?:19|20)\d{2})\b', 1) end"


@query("d18_author_overlap", "raw", f"with k as (select id, age, {_AY} as key from raw), t as (select distinct key from k where age = 'Archean' and key is not null) select id, case when key is null then 'UNKNOWN' when key in (select key from t) then 'overlap' else 'none' end as overlap from k")
def d18(raw):
    key = F.when(F.col("rock").isNotNull(), c.author_year(F.regexp_replace("citation", r"^\[\d+\] ", "")))
    rows = raw.select("id", "age", key.alias("key"))
    return e.author_overlap(F.col("key"), rows.where("age = 'Archean'"), rows.select("id", F.col("key"))).select("id", "overlap")


@query("e31_direction_summary", "scen", "with b as (select region, avg(score) as b from scen where campaign = 'view' group by region), s as (select ['N', 'E', 'S', 'W'][id % 4 + 1] as direction, 100 * (1 + id // 4 % 3) as metres, score - b as d from scen join b using (region) where campaign <> 'view') select direction, metres::int as metres, count(d) as n, avg(d) as shift, avg(abs(d)) as abs_shift, max(abs(d)) as worst from s group by 1, 2")
def e31(scen):
    base = scen.where("campaign = 'view'").groupBy("region").agg(F.avg("score").alias("b"))
    direction = F.element_at(F.array(*map(F.lit, "NESW")), (F.col("id") % 4 + 1).cast("int"))
    metres = (100 * (1 + F.floor(F.col("id") / 4) % 3)).cast("int")
    s = scen.where("campaign <> 'view'").join(base, "region").select(direction.alias("direction"), metres.alias("metres"), (F.col("score") - F.col("b")).alias("d"))
    return s.groupBy("direction", "metres").agg(F.count("d").alias("n"), F.avg("d").alias("shift"), F.avg(F.abs("d")).alias("abs_shift"), F.max(F.abs("d")).alias("worst"))


_NEAR = f"l as (select sample_id, lat, lon from geo where source = 'purchase'), r as (select distinct lat as r_lat, lon as r_lon from geo where source = 'signup'), s as (select distinct lat, lon from l), t as (select lat, lon, min({HAV}) as km from s, r group by 1, 2)"


@query("e50_distance_strata", "geo oof", f"with {_NEAR}, o as (select y, fine, km from l join t using (lat, lon) join oof using (sample_id)), u as (select 'all' as subset, y, fine from o union all select case when km >= 5e0 then 'far' else 'near' end, y, fine from o), {rank_sql('k', 'subset', 'fine', 'u')}, b as (select subset, count(*) as n, sum(y) as positives, avg((fine - y) * (fine - y)) as brier from u group by 1) select * from b left join k using (subset)")
def e50(geo, oof):
    right = geo.where("source = 'signup'").select(F.col("sample_id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    km = j.nearest(geo.where("source = 'purchase'").select("sample_id", "lat", "lon"), right, "sample_id", "r_id")
    o = oof.join(km, "sample_id")
    return e.score_metrics(a.strata(o, {"all": F.lit(True), "far": F.col("distance_km") >= 5, "near": F.col("distance_km") < 5}), ["subset"], "fine")


@query("e51_distinct_counts", "geo", "select source, count(distinct publication) as publications, true as approximation_near from geo group by 1")
def e51(geo):
    # distinct pairs first: both counts in one step would keep a sketch for every pair
    pairs = geo.select("source", "publication").distinct()
    g = pairs.groupBy("source").agg(F.count("publication").alias("publications"), F.approx_count_distinct("publication", 0.02).alias("x"))
    return g.select("source", "publications", (F.abs(F.col("x") - F.col("publications")) <= 0.1 * F.col("publications") + 1).alias("approximation_near"))


@query("f02_keep_first", "geo", "select lat, lon, min(sample_id) as sample_id from geo group by 1, 2")
def f02(geo):
    return w.keep_first(geo, ["lat", "lon"], ["sample_id"]).select("lat", "lon", "sample_id")


@query("f04_site_multiplicity", "geo", "select sample_id, count(*) over (partition by lat, lon) as n_same from geo")
def f04(geo):
    return w.multiplicity(geo, ["lat", "lon"]).select("sample_id", "n_same")


@query("f10_two_sided_pilot", "geo", f"""with c as (select *, {CELL} as cell, sha256(sample_id::varchar) as h from geo), a as (select * from c qualify row_number() over (partition by cell order by h) = 1), p as (select * from a qualify row_number() over (partition by publication order by h) = 1),
    t as (select sample_id, case when li >= 50e0 then 'high' else 'low' end as side, row_number() over (partition by li >= 50e0 order by h) as turn from p) select sample_id, side, turn::int as turn from t order by turn, side limit 24""")
def f10(geo):
    rows = geo.withColumn("cell", c.cell("lat", "lon")).withColumn("h", F.sha2(F.col("sample_id").cast("string"), 256))
    return e.two_sided_pilot(rows, "li", 50.0, "cell", "publication", ["h"], 24).select("sample_id", "side", "turn")


@query("f12_apart_pilot", "geo", f"""with o as (select *, row_number() over (order by sha256(sample_id::varchar), sample_id) as i from geo), p as (select i, [i] as ids, [lat] as lats, [lon] as lons, [publication] as refs from o where i = 1
    union all select o.i, case when ok then list_append(ids, o.i) else ids end, case when ok then list_append(lats, o.lat) else lats end, case when ok then list_append(lons, o.lon) else lons end, case when ok then list_append(refs, o.publication) else refs end
    from (select p.*, o.lat, o.lon, o.publication, o.i as oi, not list_contains(refs, o.publication) and list_min([2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(lats[k] - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(lats[k])) * pow(sin(radians(lons[k] - o.lon) / 2), 2)))) for k in range(1, len(lats) + 1)]) > 50e0 as ok from p join o on o.i = p.i + 1 where len(ids) < 8) z join o on o.i = z.oi)
    select sample_id, publication from o where i in (select unnest(ids) from p where i = (select max(i) from p))""")
def f12(geo):
    order = [F.sha2(F.col("sample_id").cast("string"), 256).alias("h"), F.col("sample_id").alias("s")]
    return e.apart_pilot(geo, "publication", order, 50.0, 8).select("sample_id", "publication")


_TR = "tr as (select k.f as tf, coarse, y from range(5) k(f) join oof on fold <> k.f)"
_FROZEN = f"""{_TR}, d as (select tf, coarse as s from tr group by all), n as (select tf, s, lead(s) over (partition by tf order by s) as nx from d), t as (select distinct tf, t from (select tf, s as t from n union all select tf, (s + nx) / 2 from n where nx is not null union all select f, unnest([0e0, 0.5e0, 1e0]) from range(5) k(f))),
    mm as (select t.tf, t, sum(case when coarse >= t and y = 1 then 1 else 0 end) as tp, sum(case when coarse >= t and y = 0 then 1 else 0 end) as fp, sum(y) as p, sum(1 - y) as q from t join tr on tr.tf = t.tf group by all),
    kk as (select tf, t, round((tp / p + 1 - fp / q) / 2, 12) as ba, round(2 * tp / (p + tp + fp), 12) as f1, round(tp / p, 12) as rec from mm), th as (select tf as fold, t as threshold from kk qualify row_number() over (partition by tf order by ba desc, f1 desc, rec desc, round(abs(t - 0.5e0), 12), t) = 1)"""


@query("f14_frozen_threshold", "oof", f"with {_FROZEN} select fold::int as fold, threshold, count(*) as n, count(*) filter (coarse >= threshold and y = 1) as tp, count(*) filter (coarse >= threshold and y = 0) as fp, count(*) filter (coarse < threshold and y = 1) as fn from oof join th using (fold) group by 1, 2")
def f14(oof):
    t = e.frozen_thresholds(oof, 5, score="coarse")
    return m.confusion(oof.join(t, "fold"), ["fold", "threshold"], F.col("threshold"), score="coarse").select("fold", "threshold", "n", "tp", "fp", "fn")


@query("n15_decision_probe", "oof", f"with {_FROZEN} select fold::int as fold, threshold, avg(((coarse >= threshold)::int = y)::int) as frozen, avg(((coarse >= 0.5e0)::int = y)::int) as at_half, count(*) filter ((coarse >= threshold) <> (coarse >= 0.5e0)) as changed from oof join th using (fold) group by 1, 2")
def n15(oof):
    rows = oof.join(e.frozen_thresholds(oof, 5, score="coarse"), "fold")
    take = F.col("coarse") >= F.col("threshold")
    right = lambda x: F.avg((x.cast("int") == F.col("y")).cast("int"))
    return rows.groupBy("fold", "threshold").agg(right(take).alias("frozen"), right(F.col("coarse") >= 0.5).alias("at_half"), F.count_if(take != (F.col("coarse") >= 0.5)).alias("changed"))


@query("f18_same_day_alternatives", "geo", "with g as (select sample_id, publication, ts::date as day, li from geo), l as (select * from g where li > 60e0) select l.sample_id, min(o.li) as best, case when min(o.li) is null then 'none' when min(o.li) < 30e0 then 'replace' else 'keep' end as decision from l left join g o on o.publication = l.publication and o.day = l.day and o.sample_id <> l.sample_id and o.li < l.li group by 1")
def f18(geo):
    g = geo.select("sample_id", "publication", F.to_date("ts").alias("day"), "li")
    # the clearest other image of a footprint and day is the group's clearest, unless that is the row itself
    best = g.groupBy("publication", "day").agg(F.min("li").alias("least"))
    rows = g.where("li > 60").join(best, ["publication", "day"]).withColumn("best", F.when(F.col("least") < F.col("li"), F.col("least")))
    return rows.select("sample_id", "best", F.when(F.col("best").isNull(), "none").when(F.col("best") < 30, "replace").otherwise("keep").alias("decision"))


@query("g02_stratified_group_folds", "oof", """with recursive_dummy as (select 1), s as (select cell, sum(y)::bigint as p, count(*) as n, row_number() over (order by sum(y) desc, count(*) desc, cell) as i from oof group by cell), r as (select 0::bigint as i, ''::varchar as cell, [0, 0, 0, 0, 0]::bigint[] as load, -1 as fold
    union all select s.i, s.cell, [case when x = list_position(r.load, list_min(r.load)) then r.load[x] + s.p * 1000000000 + s.n else r.load[x] end for x in [1, 2, 3, 4, 5]]::bigint[], (list_position(r.load, list_min(r.load)) - 1)::int from r join s on s.i = r.i + 1) select cell, fold::int as fold from r where i > 0""")
def g02(oof):
    return e.stratified_group_folds(oof, "cell", "y", 5)


_FOLD = "(floor((sample_id * 37 % 1000) / 50e0)::int % 5)"
_ARMS = f"""g as (select *, {_FOLD}::int as fold, publication || '_' || strftime(ts, '%Y-%m-%d') as scene, printf('%.5f', lat) || '|' || printf('%.5f', lon) as site, (li >= 50e0)::int as label from geo), tr as (select g.*, k.f::int as train_fold from g join range(5) k(f) on fold <> k.f),
    mx as (select train_fold, site from tr group by 1, 2 having count(distinct label) > 1), pl as (select distinct lat, lon from g), te as (select distinct lat as r_lat, lon as r_lon, fold as r_fold from g), nr as (select lat, lon, r_fold, min({HAV}) as km from pl, te group by 1, 2, 3),
    ar as (select 'all' as arm, train_fold, sample_id, li from tr union all select 'no_shared_scenes', train_fold, sample_id, li from tr where not exists (select 1 from g t where t.fold = tr.train_fold and t.scene = tr.scene) union all select 'no_mixed_sites', train_fold, sample_id, li from tr where not exists (select 1 from mx where mx.train_fold = tr.train_fold and mx.site = tr.site)
    union all select 'buffer_5km', train_fold, sample_id, li from tr join nr on nr.lat = tr.lat and nr.lon = tr.lon and nr.r_fold = tr.train_fold where km > 5e0 union all select 'buffer_10km', train_fold, sample_id, li from tr join nr on nr.lat = tr.lat and nr.lon = tr.lon and nr.r_fold = tr.train_fold where km > 10e0)"""


def _arms(geo) -> tuple[DataFrame, DataFrame]:
    fold = (F.floor((F.col("sample_id") * 37 % 1000) / 50.0) % 5).cast("int")
    g = geo.withColumn("fold", fold).withColumn("scene", F.concat_ws("_", "publication", F.date_format("ts", "yyyy-MM-dd"))).withColumn("site", c.site_id("lat", "lon")).withColumn("label", (F.col("li") >= 50).cast("int"))
    return g, e.arm_rows(g, 5, "sample_id", "scene", "site", "label", keep=("li",))


@query("g07_ablation_arms", "geo", f"with {_ARMS} select arm, train_fold, count(*) as n, sum(sample_id) as ids from ar group by 1, 2")
def g07(geo):
    return _arms(geo)[1].groupBy("arm", "train_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("n16_ablation_runs", "geo", f"with {_ARMS}, md as (select arm, train_fold, avg(li) as pred from ar group by 1, 2) select arm, fold, count(*) as n, avg(abs(li - pred)) as mae, sqrt(avg((li - pred) * (li - pred))) as rmse from g join md on md.train_fold = g.fold group by 1, 2")
def n16(geo):
    """Each arm's training mean as the model; the same test rows for all arms."""
    g, arms = _arms(geo)
    model = arms.groupBy("arm", F.col("train_fold").alias("fold")).agg(F.avg("li").alias("pred"))
    err = F.col("li") - F.col("pred")
    return g.join(F.broadcast(model), "fold").groupBy("arm", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


_FA = f"""g as (select *, {_FOLD}::int as fold, {CELL} as cell from geo), st as (select lat, lon, fold from g group by all), nr as (select a.lat, a.lon, a.fold, min({HAV}) as km from st a, (select lat as r_lat, lon as r_lon, fold as r_fold from st) b where a.fold <> b.r_fold group by all),
    sh as (select publication, count(distinct fold) as k from g group by 1), mx as (select cell, count(distinct fold) as k from g group by 1)"""
_FA = _FA.replace("radians(r_lat - lat)", "radians(r_lat - a.lat)")


@query("k04_fold_audit", "geo", f"with {_FA} select fold, count(*) as n_test, (select count(*) from g) - count(*) as n_train, min(km) as min_km, count(*) filter (km < 5e0) as n_too_close, count(*) filter (sh.k > 1) as n_shared, count(*) filter (mx.k > 1) as n_mixed_groups from g join nr using (lat, lon, fold) join sh using (publication) join mx using (cell) group by fold")
def k04(geo):
    g = geo.withColumn("fold", (F.floor((F.col("sample_id") * 37 % 1000) / 50.0) % 5).cast("int")).withColumn("cell", c.cell("lat", "lon"))
    return e.fold_audit(g, "sample_id", "fold", "cell", "publication")


_GAPS = "m as (select image_id, band, y, x, case when v > 0 then v end as v from px)"


@query("i11_patch_inventory", "pixels", f"with {PX}, {_GAPS}, b as (select image_id, band, avg((v is not null)::int) as valid from m group by 1, 2) select image_id, case when image_id % 2 = 0 then 'historical' else 'expansion' end as cohort, count(*) as bands, min(valid) as worst, avg(valid) as mean, min(valid) < 0.95e0 as low_coverage from b group by 1")
def i11(df):
    gaps = r.missingness(r.pixels(df, "vec_id", "embedding").withColumn("v", F.when(F.col("v") > 0, F.col("v")))).select("image_id", "band", "valid")
    g = gaps.groupBy("image_id").agg(F.count(F.lit(1)).alias("bands"), F.min("valid").alias("worst"), F.avg("valid").alias("mean"))
    return g.withColumn("low_coverage", F.col("worst") < 0.95).withColumn("cohort", F.when(F.col("image_id") % 2 == 0, "historical").otherwise("expansion"))


@query("i12_patch_quality", "pixels", f"""with {PX}, q as (select image_id, y, x, bool_and(v > -1.5e0) as ok, max(v) filter (band = 'red') as red, max(v) filter (band = 'nir') as nir from px group by 1, 2, 3), n as (select *, case when ok and abs(nir + red) > 1e-6 then (nir - red) / (nir + red) end as ndvi from q),
    g as (select image_id, avg(ok::int) as joint_valid, quantile_cont(ndvi, 0.5) as ndvi_p50, avg((ndvi > 0.4e0)::int) as green_share, avg(red) filter (y between 2 and 5 and x between 2 and 5) - avg(red) as centre_shift from n group by 1)
    select *, joint_valid < 0.95e0 as low_coverage, case when joint_valid = 0 then 'empty' when joint_valid < 0.95e0 then 'partial' else 'complete' end as integrity from g""")
def i12(df):
    return e.patch_quality(r.pixels(df, "vec_id", "embedding"), F.col("v") > -1.5)


@query("k01_target_leakage", "oxides", "with o as (select *, li as copy, li as \"LI \" from oxides) " + " union all ".join(f"select '{x}' as feature, {str(x.strip() == 'LI').lower()} as same_name, count(*) filter (\"{x}\" = li) as equal_rows, {str(x.strip() == 'LI').lower()} or count(*) filter (\"{x}\" = li) = count(li) as leaks from o" for x in ("SiO2", "CaO", "MgO", "Rb", "copy", "LI ")))
def k01(oxides):
    return e.leaking(oxides.withColumn("copy", F.col("li")).withColumn("LI ", F.col("li")), "li", ["SiO2", "CaO", "MgO", "Rb", "copy", "LI "])


_PAIR = f"{rank_sql('fa', 'cohort', 'fine', 'oof')}, {rank_sql('ca', 'cohort', 'coarse', 'oof')}, bb as (select cohort, count(*) as n, sum(y) as positives, count(distinct fold) as regions, avg((fine - y) * (fine - y)) as brier, avg((coarse - y) * (coarse - y)) as reference_brier from oof group by 1), ev as (select bb.*, fa.auc, fa.ap, ca.auc as reference_auc, ca.ap as reference_ap from bb join fa using (cohort) join ca using (cohort))"
POLICY = {"regions": 3, "n": 300, "positives": 40, "negatives": 60, "auc": 0.65, "auc_gain": 0.0, "ap_gain": -0.02, "brier_loss": 0.01}


def _evidence(oof):
    one, two = e.score_metrics(oof, ["cohort"], "fine"), e.score_metrics(oof, ["cohort"], "coarse").select("cohort", *(F.col(x).alias(f"reference_{x}") for x in ("auc", "ap", "brier")))
    return one.join(two, "cohort").join(oof.groupBy("cohort").agg(F.countDistinct("fold").alias("regions")), "cohort")


@query("k09_release_gate", "oof", f"""with {_PAIR}, v as (select cohort, list_filter([case when cohort = 'view' then 'source_not_independent' end, case when regions < 3 then 'too_few_regions' end, case when n < 300 then 'too_few_samples' end, case when positives < 40 then 'too_few_positives' end, case when n - positives < 60 then 'too_few_negatives' end,
    case when not coalesce(auc >= 0.65e0, false) then 'auc_below_minimum' end, case when not coalesce(auc - reference_auc >= 0, false) then 'auc_below_reference' end, case when not coalesce(ap - reference_ap >= -0.02e0, false) then 'ap_regression' end, case when not coalesce(brier - reference_brier <= 0.01e0, false) then 'calibration_regression' end], lambda z: z is not null) as l from ev)
    select cohort, array_to_string(l, ',') as violations, len(l) = 0 as evidence_passes from v""")
def k09(oof):
    ev = _evidence(oof).withColumn("independent", F.col("cohort") != "view").withColumn("unconsulted", F.lit(True)).withColumn("duplicates", F.lit(0))
    return e.release_gate(ev, POLICY).select("cohort", "violations", "evidence_passes")


@query("k12_baseline_gain", "oof", f"with {_PAIR} select cohort, auc - reference_auc as auc_gain, ap - reference_ap as ap_gain, auc - reference_auc >= 0.02e0 and ap - reference_ap >= 0.01e0 as passes from ev")
def k12(oof):
    ev = _evidence(oof).select("cohort", (F.col("auc") - F.col("reference_auc")).alias("auc_gain"), (F.col("ap") - F.col("reference_ap")).alias("ap_gain"))
    return ev.withColumn("passes", (F.col("auc_gain") >= 0.02) & (F.col("ap_gain") >= 0.01))


@query("n01_eligible_pairs", "oxides geo", f"with b as (select *, coalesce(measured_total, {' + '.join(c.OXIDES)}) as total from oxides), k as (select sample_id, lat, lon, {CELL} as cell, source from b where total between 94 and 102 and li is not null and sample_id not in (select publication from geo) qualify row_number() over (partition by lat, lon order by sample_id) = 1) select sample_id, cell, source from k")
def n01(oxides, geo):
    total = F.coalesce("measured_total", c.closure(*c.OXIDES))
    rows = oxides.where(total.between(94, 102) & F.col("li").isNotNull()).join(geo.select(F.col("publication").alias("sample_id")).distinct(), "sample_id", "left_anti")
    return w.keep_first(rows.withColumn("cell", c.cell("lat", "lon")), ["lat", "lon"], ["sample_id"]).select("sample_id", "cell", "source")


_COLS = ("SiO2", "Al2O3", "FeOT", "Rb", "Sr")


@query("n03_stage_evidence", "oxides", " union all ".join(f"select '{x}' as name, count({x}) filter (li is not null) as with_li, count({x}) filter (li is null) as without_li, quantile_cont({x}, 0.5) as p50 from oxides" for x in _COLS))
def n03(oxides):
    long = oxides.select("li", F.inline(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("v")) for x in _COLS))))
    return long.groupBy("name").agg(F.count_if(F.col("v").isNotNull() & F.col("li").isNotNull()).alias("with_li"), F.count_if(F.col("v").isNotNull() & F.col("li").isNull()).alias("without_li")).transform(lambda g: with_quantiles(g, ["name"], quantiles(long, ["name"], F.col("v"), {"p50": 0.5})))


@query("n04_coordinate_suitability", "raw", "with k as (select coalesce(try_cast(lon_a as double), try_cast(lon_b as double)) as lon, try_cast(lat_text as double) as lat from raw) select count(*) as n, count(lon) as readable_lon, count(lat) as readable_lat, count(*) filter (lon is null or lat is null) as discarded, quantile_cont(lon, 0.5) as lon_p50, min(lat) as lat_low, max(lat) as lat_high, count(distinct case when lon is not null and lat is not null then " + CELL + " end) as cells from k")
def n04(raw):
    k = raw.select(c.first_number("lon_a", "lon_b").alias("lon"), c.number("lat_text").alias("lat"))
    both = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return k.agg(F.count(F.lit(1)).alias("n"), F.count("lon").alias("readable_lon"), F.count("lat").alias("readable_lat"), F.count_if(~both).alias("discarded"), F.min("lat").alias("lat_low"), F.max("lat").alias("lat_high"), F.countDistinct(F.when(both, c.cell("lat", "lon"))).alias("cells")).transform(lambda g: with_quantiles(g, [], quantiles(k, [], F.col("lon"), {"lon_p50": 0.5})))


@query("n05_specimen_audit", "oxides export", """with x as (select cast(id as bigint) as sample_id, count(*) as matches, max(try_cast(SiO2 as double)) as raw_silica, max(try_cast(CaO as double)) as raw_lime, max(material) as material from export group by 1)
    select sample_id, coalesce(matches, 0) as matches, coalesce(abs(SiO2 - raw_silica) <= 1e-6, false) as silica_agrees, coalesce(abs(CaO - raw_lime) <= 1e-6, false) as lime_agrees, case when coalesce(matches, 0) <> 1 then 'no_single_match' when raw_silica is null or raw_lime is null then 'unreadable' when abs(SiO2 - raw_silica) <= 1e-6 and abs(CaO - raw_lime) <= 1e-6 then 'verified' else 'disagrees' end as status from oxides left join x using (sample_id)""")
def n05(oxides, export):
    x = export.groupBy(F.col("id").cast("bigint").alias("sample_id")).agg(F.count(F.lit(1)).alias("matches"), F.max(c.number("SiO2")).alias("raw_silica"), F.max(c.number("CaO")).alias("raw_lime"))
    near = lambda p, q: F.coalesce(F.abs(F.col(p) - F.col(q)) <= 1e-6, F.lit(False))
    both = j.many_to_one(oxides, x, ["sample_id"]).withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))
    both = both.withColumn("silica_agrees", near("SiO2", "raw_silica")).withColumn("lime_agrees", near("CaO", "raw_lime"))
    status = c.first_true((F.col("matches") != 1, "no_single_match"), (F.col("raw_silica").isNull() | F.col("raw_lime").isNull(), "unreadable"), (F.col("silica_agrees") & F.col("lime_agrees"), "verified"), default="disagrees")
    return both.select("sample_id", "matches", "silica_agrees", "lime_agrees", status.alias("status"))


@query("n06_evidence_lookup", "raw", "select id, case verification when 'gps_and_surface_verified' then 'field' when 'drill_core sample' then 'core' when 'PROVISIONAL_SITE_REVIEW' then 'desk' end as evidence, case verification when 'gps_and_surface_verified' then 'admitted' when 'drill_core sample' then 'rejected' when 'PROVISIONAL_SITE_REVIEW' then 'pending' else 'no_evidence' end as status from raw")
def n06(raw):
    known = raw.sparkSession.createDataFrame([("gps_and_surface_verified", "field", "admitted"), ("drill_core sample", "core", "rejected"), ("PROVISIONAL_SITE_REVIEW", "desk", "pending")], "verification string, evidence string, status string")
    return raw.join(F.broadcast(known), "verification", "left").select("id", "evidence", F.coalesce("status", F.lit("no_evidence")).alias("status"))


@query("n07_same_scene_pairs", "scen", "with k as (select id, campaign, region, season, year, 'pair_' || id // 2 as pair from scen) select a.pair, a.id as centre, b.id as shifted, a.campaign = b.campaign as same_scene from k a join k b on a.pair = b.pair and a.id < b.id")
def n07(scen):
    k = scen.select("id", "campaign", F.concat(F.lit("pair_"), F.floor(F.col("id") / 2).cast("string")).alias("pair"))
    two = k.groupBy("pair").agg(F.min(F.struct("id", "campaign")).alias("a"), F.max(F.struct("id", "campaign")).alias("b"), F.count(F.lit(1)).alias("n"))
    return two.where("n = 2").select("pair", F.col("a.id").alias("centre"), F.col("b.id").alias("shifted"), (F.col("a.campaign") == F.col("b.campaign")).alias("same_scene"))


@query("n08_decision_ledger", "geo", "with p as (select publication, count(*) as n_pub, max(li) as top, count(distinct source) as kinds from geo group by 1) select sample_id, n_pub, top, case when source = 'purchase' and li > 150e0 then 'override_review' when n_pub < 5 then 'too_few_rows' when kinds < 3 then 'one_sided' when li is null then 'no_value' else 'accepted' end as decision from geo join p using (publication)")
def n08(geo):
    p = geo.groupBy("publication").agg(F.count(F.lit(1)).alias("n_pub"), F.max("li").alias("top"), F.countDistinct("source").alias("kinds"))
    decision = c.first_true((F.coalesce((F.col("source") == "purchase") & (F.col("li") > 150), F.lit(False)), "override_review"), (F.col("n_pub") < 5, "too_few_rows"), (F.col("kinds") < 3, "one_sided"), (F.col("li").isNull(), "no_value"), default="accepted")
    return geo.join(p, "publication").select("sample_id", "n_pub", "top", decision.alias("decision"))


def stored_arms(oof) -> DataFrame:
    """Three runs' out-of-fold files, read as one table with the arm from the path; one run lacks a cohort."""
    at = folder(oof.sparkSession, "arms")
    for arm, score, rows in (("fine", F.col("fine"), oof), ("coarse", F.col("coarse"), oof), ("mean", (F.col("fine") + F.col("coarse")) / 2, oof.where("cohort <> 'view'"))):
        rows.select("sample_id", "fold", "y", "cohort", score.alias("score")).write.parquet(f"{at}/{arm}")
    read = oof.sparkSession.read.parquet(f"{at}/*").withColumn("arm", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return e.common_rows(read, "sample_id", "arm", "y", "fold")


_LONG = "oo as (select * from oof where cohort <> 'view'), lo as (select 'fine' as arm, fine as score, * from oo union all select 'coarse', coarse, * from oo union all select 'mean', (fine + coarse) / 2, * from oo)"
_ARMK = f"{_LONG}, {rank_sql('ak', 'arm', 'score', 'lo')}, ab as (select arm, count(*) as n, sum(y) as positives, avg((score - y) * (score - y)) as brier from lo group by 1)"


@query("n09_multi_run_loader", "oof", f"with {_LONG} select arm, count(*) as n, avg(score) as mean from lo group by 1")
def n09(oof):
    return stored_arms(oof).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


@query("n11_common_rows_comparison", "oof", f"with {_LONG}, q as (select cohort, avg(abs(score - y)) filter (arm = 'mean') as new_mae, avg(abs(score - y)) filter (arm = 'coarse') as old_mae from lo group by 1) select cohort, new_mae, old_mae, new_mae - old_mae as delta from q")
def n11(oof):
    err = F.abs(F.col("score") - F.col("y"))
    q = stored_arms(oof).groupBy("cohort").agg(F.avg(F.when(F.col("arm") == "mean", err)).alias("new_mae"), F.avg(F.when(F.col("arm") == "coarse", err)).alias("old_mae"))
    return q.withColumn("delta", F.col("new_mae") - F.col("old_mae"))


@query("n21_candidate_batch", "oof", f"with {_ARMK}, x as (select ab.*, ak.auc, ak.ap from ab join ak using (arm)) select n.arm, n.auc - o.auc as auc_gain, o.brier - n.brier as brier_gain, array_to_string(list_filter([case when n.auc < o.auc then 'auc' end, case when n.ap < o.ap then 'ap' end, case when n.brier > o.brier then 'brier' end], lambda z: z is not null), ',') as reasons from x n, x o where o.arm = 'coarse' and n.arm <> 'coarse'")
def n21(oof):
    x = e.score_metrics(stored_arms(oof), ["arm"], "score")
    active, pending = x.where("arm = 'coarse'").withColumn("k", F.lit(1)), x.where("arm <> 'coarse'").withColumn("k", F.lit(1))
    rows = pending.join(F.broadcast(active.select("k", *(F.col(v).alias(f"o_{v}") for v in ("auc", "ap", "brier")))), "k")
    why = d.reasons(auc=F.col("auc") >= F.col("o_auc"), ap=F.col("ap") >= F.col("o_ap"), brier=F.col("brier") <= F.col("o_brier"))
    return rows.select("arm", (F.col("auc") - F.col("o_auc")).alias("auc_gain"), (F.col("o_brier") - F.col("brier")).alias("brier_gain"), why.alias("reasons"))


@query("n13_whole_run_comparison", "oof", "select fold, count(*) as n, avg(abs(fine - y)) as fine_mae, avg(abs(coarse - y)) as coarse_mae, avg(abs((fine + coarse) / 2 - y)) as mean_mae, max(abs(fine - coarse)) as largest_difference, avg(abs(fine - y)) <= 0.95e0 * avg(abs(coarse - y)) as gate from oof group by fold")
def n13(oof):
    mae = lambda s: F.avg(F.abs(s - F.col("y")))
    g = oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), mae(F.col("fine")).alias("fine_mae"), mae(F.col("coarse")).alias("coarse_mae"), mae((F.col("fine") + F.col("coarse")) / 2).alias("mean_mae"), F.max(F.abs(F.col("fine") - F.col("coarse"))).alias("largest_difference"))
    return g.withColumn("gate", F.col("fine_mae") <= 0.95 * F.col("coarse_mae"))


@query("n14_region_summary", "geo oof", "select case when lat <= -25e0 then '(-30,-25]' when lat <= -20e0 then '(-25,-20]' else '(-20,-15]' end as region, count(*) as n, count(distinct cell) as sites, avg(fine) as mean_score, quantile_cont(fine, 0.5) as median_score, avg(y) as rate from oof join geo using (sample_id) group by 1")
def n14(geo, oof):
    region = c.first_true((F.col("lat") <= -25, "(-30,-25]"), (F.col("lat") <= -20, "(-25,-20]"), default="(-20,-15]")
    rows = oof.join(geo.select("sample_id", "lat"), "sample_id").withColumn("region", region)
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("sites"), F.avg("fine").alias("mean_score"), F.avg("y").alias("rate")).transform(lambda g: with_quantiles(g, ["region"], quantiles(rows, ["region"], F.col("fine"), {"median_score": 0.5})))


@query("n19_evidence_recomputation", "oof", f"with {rank_sql('k', 'fold', 'fine', 'oof')}, g as (select fold, count(*) as n, count(distinct cell) as groups from oof group by 1) select fold, n, groups, auc, n + (fold = 0)::int as recorded_n, fold <> 0 as agrees from g join k using (fold)")
def n19(oof):
    at = folder(oof.sparkSession, "recorded")
    # what an earlier run recorded, with an error in one fold
    oof.groupBy("fold").agg((F.count(F.lit(1)) + F.max((F.col("fold") == 0).cast("int"))).alias("recorded_n"), F.countDistinct("cell").alias("recorded_groups")).write.json(at)
    recorded = oof.sparkSession.read.schema("fold int, recorded_n bigint, recorded_groups bigint").json(at)
    now = e.score_metrics(oof, ["fold"], "fine").join(oof.groupBy("fold").agg(F.countDistinct("cell").alias("groups")), "fold")
    ok = (F.col("n") == F.col("recorded_n")) & (F.col("groups") == F.col("recorded_groups"))
    return j.one_to_one(now, recorded, ["fold"]).select("fold", "n", "groups", "auc", "recorded_n", ok.alias("agrees"))


_SCEN = "sc as (select image_id, 'baseline' as scenario, band, v from px union all select image_id, 'bright', band, v * 1.2e0 from px union all select image_id, 'dark', band, v * 0.8e0 from px)"


@query("n23_scenario_batch", "pixels", f"with {PX}, {_SCEN}, s as (select image_id, scenario, avg(v) as score, max(v) as top from sc group by 1, 2), b as (select image_id, score as base from s where scenario = 'baseline') select scenario, count(*) as images, avg(score - base) as shift, max(abs(score - base)) as worst, avg((top > 0.6e0)::int) as ood_rate from s join b using (image_id) group by 1")
def n23(df):
    px = r.pixels(df, "vec_id", "embedding")
    s = px.select("image_id", F.inline(F.array(*(F.struct(F.lit(k).alias("scenario"), (F.col("v") * g).alias("v")) for k, g in (("baseline", 1.0), ("bright", 1.2), ("dark", 0.8))))))
    s = s.groupBy("image_id", "scenario").agg(F.avg("v").alias("score"), F.max("v").alias("top"))
    base = s.where("scenario = 'baseline'").select("image_id", F.col("score").alias("base"))
    d_ = F.col("score") - F.col("base")
    return s.join(base, "image_id").groupBy("scenario").agg(F.count(F.lit(1)).alias("images"), F.avg(d_).alias("shift"), F.max(F.abs(d_)).alias("worst"), F.avg((F.col("top") > 0.6).cast("int")).alias("ood_rate"))


@query("n25_artefact_tables", "reg", "select 'describe' as artefact, 'y' as name, count(*) * 1e0 as n, avg(y) as mean, stddev_samp(y) as spread from reg union all select 'describe', 'pred', count(*), avg(pred), stddev_samp(pred) from reg union all select 'fold', cast(fold as varchar), count(*), avg(pred - y), stddev_samp(pred - y) from reg group by fold")
def n25(reg):
    stats = lambda df, kind, name, v: df.groupBy(F.lit(kind).alias("artefact"), name.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("spread"))
    parts = [stats(reg, "describe", F.lit(x), F.col(x)) for x in ("y", "pred")] + [stats(reg, "fold", F.col("fold").cast("string"), F.col("pred") - F.col("y"))]
    return reduce(DataFrame.unionByName, parts)


@query("d20_bibliography_complete", "raw", r"with k as (select distinct regexp_extract(citation, '^\[(\d+)\]', 1) as n from raw where age = 'Archean'), i as (select id, unnest(regexp_extract_all(citation, '\[(\d+)\]', 1)) as n from raw) select i.id, count(*) filter (k.n is null) as unresolved, bool_and(k.n is not null) as complete from i left join k on i.n = k.n group by i.id")
def d20(raw):
    known = t.bibliography(raw.where("age = 'Archean'"), "citation").select(F.col("id").alias("n")).distinct().withColumn("hit", F.lit(True))
    ids = raw.select("id", F.explode(c.citation_ids("citation")).alias("n")).join(known, "n", "left")
    return ids.groupBy("id").agg(F.count_if(F.col("hit").isNull()).alias("unresolved"), F.bool_and(F.col("hit").isNotNull()).alias("complete"))


@query("e43_publication_priority", "geo", f"with l as (select * from geo where source <> 'signup'), r as (select distinct lat as r_lat, lon as r_lon from geo where source = 'signup'), s as (select distinct lat, lon from l), t as (select lat, lon, min({HAV}) as km from s, r group by 1, 2) select publication, count(*) as n, min(km) as nearest_km, max(li) as top_li, count(*) * (1 + min(km)) as score from l join t using (lat, lon) group by publication order by score desc, publication limit 10")
def e43(geo):
    rows = geo.where("source <> 'signup'")
    km = j.nearest(rows, geo.where("source = 'signup'").select(F.col("sample_id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), "sample_id", "r_id")
    g = rows.join(km, "sample_id").groupBy("publication").agg(F.count(F.lit(1)).alias("n"), F.min("distance_km").alias("nearest_km"), F.max("li").alias("top_li"))
    return w.top(g.withColumn("score", F.col("n") * (1 + F.col("nearest_km"))), 10, F.desc(F.round("score", 9)), F.col("publication"))


_SIDES = "u as (select case when cohort = 'click' then 'external' else 'training' end as side, * from oof)"


@query("e39_train_external_delta", "oof", f"with {_SIDES}, {rank_sql('k', 'side', 'fine', 'u')}, b as (select side, avg((fine - y) * (fine - y)) as brier from u group by 1), v as (select unnest(['auc', 'ap', 'brier']) as metric, unnest([auc, ap, brier]) as v, side from k join b using (side)) select metric, max(v) filter (side = 'training') as training, max(v) filter (side = 'external') as external, max(v) filter (side = 'external') - max(v) filter (side = 'training') as delta from v group by 1")
def e39(oof):
    side = F.when(F.col("cohort") == "click", "external").otherwise("training")
    g = e.score_metrics(oof.withColumn("side", side), ["side"], "fine")
    long = g.select("side", F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in ("auc", "ap", "brier")))))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return long.groupBy("metric").agg(of("training").alias("training"), of("external").alias("external")).withColumn("delta", F.col("external") - F.col("training"))


@query("e40_external_metrics", "scen oof", "with p as (select campaign, fine, score from scen join oof on sample_id = id where score is not null and year = 2021) select campaign, count(*) as n, sqrt(avg((score - fine) * (score - fine))) as rmse, avg(abs(score - fine)) as mae, avg(score - fine) as bias from p group by campaign having count(*) >= 2")
def e40(scen, oof):
    """External cases are one year's; a campaign with fewer than two scored ones has no row."""
    pairs = scen.where("year = 2021").join(oof.select(F.col("sample_id").alias("id"), "fine"), "id")
    return m.regression(pairs, ["campaign"], "fine", "score").where("n >= 2").select("campaign", "n", "rmse", "mae", "bias")


_C = f"coalesce(measured_total, {' + '.join(c.OXIDES)})"


@query("n02_variant_frames", "oxides", f"with q as (select *, {_C} as total from oxides) select 'A' as variant, sample_id, li from q where measured_total between 94 and 102 and li is not null union all select 'B', sample_id, li from q where total between 94 and 102 and li is not null union all select 'all', sample_id, li from q where li is not null")
def n02(oxides):
    masked = a.protocol_masks(oxides).where("li is not null")
    frames: list[DataFrame] = [masked.where(k).select(F.lit(v).alias("variant"), "sample_id", "li") for v, k in (("A", F.col("A_original")), ("B", F.col("B_reconstructed")), ("all", F.lit(True)))]
    return reduce(DataFrame.unionByName, frames)


_MATRIX = ("SiO2", "TiO2", "Al2O3", "MgO", "CaO")


@query("n20_matrix_verification", "oxides export", "with x as (select cast(id as bigint) as sample_id, " + ", ".join(f"try_cast({k} as double) as x_{k}" for k in _MATRIX) + " from export) " + " union all ".join(f"select '{k}' as feature, count(*) as rows, max(abs({k} - x_{k})) as worst, count(*) filter (({k} is null) <> (x_{k} is null)) as one_sided, coalesce(max(abs({k} - x_{k})) <= 1e-9, true) and count(*) filter (({k} is null) <> (x_{k} is null)) = 0 as agrees from oxides full join x using (sample_id)" for k in _MATRIX))
def n20(oxides, export):
    """The number table against the same features read from text: rows, the largest difference and values that only one side has."""
    x = export.select(F.col("id").cast("bigint").alias("sample_id"), *(c.number(k).alias(f"x_{k}") for k in _MATRIX))
    both = oxides.select("sample_id", *_MATRIX).join(x, "sample_id", "full")
    long = both.select(F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("p"), F.col(f"x_{k}").alias("q")) for k in _MATRIX))))
    g = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("p") - F.col("q"))).alias("worst"), F.count_if(F.col("p").isNull() != F.col("q").isNull()).alias("one_sided"))
    return g.withColumn("agrees", F.coalesce(F.col("worst") <= 1e-9, F.lit(True)) & (F.col("one_sided") == 0))


@query("n22_top3_integration", "paired", "with t as (select * from paired qualify row_number() over (partition by grp order by predicted desc, case_id) <= 3), p as (select grp, arg_max(case_id, struct_pack(s := score, k := -case_id)) as chosen, max(score) as chosen_score from t group by 1), o as (select grp, arg_max(case_id, struct_pack(b := balance, k := -case_id)) as observed from paired group by 1) select grp, chosen, chosen_score, observed, chosen = observed as hit from p join o using (grp)")
def n22(paired):
    """In every group: the best by the second score among the three best by the first, beside the observed best."""
    best = lambda df, by, name: df.groupBy("grp").agg(F.max(F.struct(F.col(by).alias("v"), (-F.col("case_id")).alias("k"))).alias("m")).select("grp", (-F.col("m.k")).alias(name), F.col("m.v").alias(f"{name}_score"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("predicted"), "case_id"))
    top = paired.withColumn("place", place).where("place <= 3")
    return best(top, "score", "chosen").join(best(paired, "balance", "observed").drop("observed_score"), "grp").withColumn("hit", F.col("chosen") == F.col("observed"))


@query("k11_development_gates", "oof", f"with {_PAIR}, er as (select cohort, count(*) filter (fine >= 0.05e0) / count(*) as coverage, avg(abs(fine - y)) / avg(abs(coarse - y)) - 1 as change from oof group by 1), g as (select cohort, coverage, change, auc - reference_auc as auc_gain, ap - reference_ap as ap_gain, brier - reference_brier as brier_loss from ev join er using (cohort)) select *, array_to_string(list_filter([case when coverage < 0.8e0 then 'coverage' end, case when change > -0.05e0 then 'error' end, case when auc_gain < 0.03e0 then 'auc' end, case when ap_gain < 0.02e0 then 'ap' end, case when brier_loss > 0.01e0 then 'brier' end], lambda z: z is not null), ',') as reasons from g")
def k11(oof):
    mae = lambda s: F.avg(F.abs(F.col(s) - F.col("y")))
    er = oof.groupBy("cohort").agg((F.count_if(F.col("fine") >= 0.05) / F.count(F.lit(1))).alias("coverage"), (mae("fine") / mae("coarse") - 1).alias("change"))
    gain = [(F.col(k) - F.col(f"reference_{k}")).alias(n) for k, n in (("auc", "auc_gain"), ("ap", "ap_gain"), ("brier", "brier_loss"))]
    g = _evidence(oof).select("cohort", *gain).join(er, "cohort")
    return g.withColumn("reasons", d.reasons(coverage=F.col("coverage") >= 0.8, error=F.col("change") <= -0.05, auc=F.col("auc_gain") >= 0.03, ap=F.col("ap_gain") >= 0.02, brier=F.col("brier_loss") <= 0.01))
