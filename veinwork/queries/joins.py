"""Queries of joins, set operations, folds and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import folds as f
from veinwork.operators import joins as j
from veinwork.operators import windows as w

from .registry import query

HAV = "2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(r_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(r_lat)) * pow(sin(radians(r_lon - lon) / 2), 2))))"
SIDES = "l as (select sample_id, lat, lon, li from geo where source = 'purchase'), r as (select sample_id as r_id, lat as r_lat, lon as r_lon, li as r_li from geo where source = 'signup')"


def _sides(geo):
    left = geo.where("source = 'purchase'").select("sample_id", "lat", "lon", "li")
    return left, geo.where("source = 'signup'").select(F.col("sample_id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("li").alias("r_li"))


@query("d01_one_to_one", "paired", "select case_id, predicted, score, predicted - score as gap from paired")
def d01(paired):
    return j.one_to_one(paired.select("case_id", "predicted"), paired.select("case_id", "score"), ["case_id"]).withColumn("gap", F.col("predicted") - F.col("score"))


@query("d02_many_to_one", "geo", "with m as (select publication, min(sample_id) as first_id, count(*) as n from geo group by publication) select sample_id, first_id, n from geo left join m using (publication)")
def d02(geo):
    m = geo.groupBy("publication").agg(F.min("sample_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return j.many_to_one(geo, m, ["publication"]).select("sample_id", "first_id", "n")


@query("d04_tolerance_link", "geo", f"with {SIDES} select sample_id, count(*) as matches, string_agg(r_id, ',' order by r_id) as ids from l join r on l.lat = r.r_lat and abs(l.li - r.r_li) <= 5e0 and abs(l.lon - r.r_lon) <= 1e-6 group by sample_id")
def d04(geo):
    left, right = _sides(geo)
    hits = j.within_tolerance(left, right.withColumn("lat", F.col("r_lat")), ["lat"], {"li": "r_li"}, 5.0).where(F.abs(F.col("lon") - F.col("r_lon")) <= 1e-6)
    return hits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_list("r_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("d07_nearest_neighbour", "geo", f"with {SIDES}, s as (select r_lat, r_lon, min(r_id) as r_id from r group by 1, 2), d as (select sample_id, r_id, {HAV} as km from l, s) select sample_id, round(min(km), 6) as distance_km from d group by sample_id")
def d07(geo):
    left, right = _sides(geo)
    return j.nearest(left, right, "sample_id", "r_id").select("sample_id", "distance_km")


@query("d08_radius_semi", "geo", f"with {SIDES} select sample_id from l where exists (select 1 from r where {HAV} <= 3e0)")
def d08(geo):
    return j.any_within(*_sides(geo), "sample_id", 3.0).select("sample_id")


@query("d08_radius_anti", "geo", f"with {SIDES} select sample_id from l where not exists (select 1 from r where {HAV} <= 3e0)")
def d08_anti(geo):
    return j.none_within(*_sides(geo), "sample_id", 3.0).select("sample_id")


@query("d09_duplicate_evidence", "geo", f"with {SIDES} select sample_id, count(*) as n, min(r_id) as first_id from l join r on {HAV} <= 0.1e0 and abs(li - r_li) <= 5e0 group by sample_id")
def d09(geo):
    pairs = j.radius_pairs(*_sides(geo), 0.1).where(F.abs(F.col("li") - F.col("r_li")) <= 5.0)
    return pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("r_id").alias("first_id"))


@query("d10_exact_overlap", "geo", "select (select count(*) from (select lat, lon from geo where source = 'purchase' intersect select lat, lon from geo where source = 'signup')) as places, (select count(*) from (select publication from geo where source = 'purchase' intersect select publication from geo where source = 'signup')) as publications")
def d10(geo):
    a, b = geo.where("source = 'purchase'"), geo.where("source = 'signup'")
    both = lambda *k: a.select(*k).intersect(b.select(*k)).agg(F.count(F.lit(1)).alias("n"))
    return both("lat", "lon").withColumnRenamed("n", "places").join(both("publication").withColumnRenamed("n", "publications"), how="inner")


@query("d11_unambiguous_pairs", "geo", f"with {SIDES}, a as (select lat, lon from l group by 1, 2 having count(*) = 1), b as (select r_lat, r_lon from r group by 1, 2 having count(*) = 1) select sample_id, r_id from l join a using (lat, lon) join r on r_lat = l.lat and r_lon = l.lon join b on b.r_lat = r.r_lat and b.r_lon = r.r_lon")
def d11(geo):
    left, right = _sides(geo)
    return j.unambiguous(left, right.withColumnsRenamed({"r_lat": "lat", "r_lon": "lon"}), ["lat", "lon"]).select("sample_id", "r_id")


@query("d12_new_cells", "geo", "with g as (select *, floor((lat + 90) / 0.5e0) as a, floor((lon + 180) / 0.5e0) as o from geo) select sample_id from g where source = 'signup' and not exists (select 1 from g k where k.source = 'purchase' and k.a = g.a and k.o = g.o)")
def d12(geo):
    g = geo.withColumn("cell", c.cell("lat", "lon"))
    return g.where("source = 'signup'").join(g.where("source = 'purchase'").select("cell").distinct(), "cell", "left_anti").select("sample_id")


@query("d13_heldout_train", "oof", "with t as (select distinct fold, cell from oof) select f.fold as fold, count(*) as rows from (select distinct fold from oof) f, oof o where not exists (select 1 from t where t.fold = f.fold and t.cell = o.cell) group by 1")
def d13(oof):
    tests = oof.select(F.col("fold").alias("train_fold"), "cell").distinct()
    return f.training_rows(oof, 5).join(tests, ["train_fold", "cell"], "left_anti").groupBy(F.col("train_fold").alias("fold")).agg(F.count(F.lit(1)).alias("rows"))


@query("d14_shared_attribute", "geo", "select sample_id, source = 'purchase' and publication in (select publication from geo where source = 'signup') as shared from geo where source = 'purchase'")
def d14(geo):
    g = geo.withColumn("p", F.col("publication").cast("string"))
    return j.shared_values(g.where("source = 'purchase'"), g.where("source = 'signup'"), "p", "shared").select("sample_id", "shared")


@query("d19_paired_arms", "oof", "select sample_id, fine - coarse as delta from oof")
def d19(oof):
    arms = j.one_to_one(oof.select("sample_id", "y", "fine"), oof.select("sample_id", F.col("y").alias("y2"), "coarse"), ["sample_id"])
    j.assert_empty(arms.where("not (y <=> y2)"), "labels differ between arms")
    return arms.select("sample_id", (F.col("fine") - F.col("coarse")).alias("delta"))


@query("d21_coordinate_plan", "geo", "select sample_id, dense_rank() over (order by lat, lon) as plan_id from geo")
def d21(geo):
    from pyspark.sql import Window

    plan = geo.select("lat", "lon").distinct().withColumn("band", F.floor("lat"))
    inside = Window.partitionBy("band").orderBy("lat", "lon")
    ahead = plan.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ids = plan.withColumn("r", F.row_number().over(inside)).join(ahead, "band").select("lat", "lon", (F.col("r") + F.col("off")).alias("plan_id"))
    return geo.join(ids, ["lat", "lon"]).select("sample_id", "plan_id")


@query("d22_control_plan", "geo", """with ce as (select distinct lat, lon from geo), d as (select unnest([250e0, 500e0, 1000e0]) as m), x as (select unnest(['N', 'E', 'S', 'W']) as dir)
    select round(lat, 6) as lat, round(lon, 6) as lon, 0e0 as m, 'C' as dir from ce union all select round(lat + case dir when 'N' then 1 when 'S' then -1 else 0 end * m / 111132e0, 6), round(lon + case dir when 'E' then 1 when 'W' then -1 else 0 end * m / (111320e0 * cos(radians(lat))), 6), m, dir from ce, d, x""")
def d22(geo):
    centres = geo.select("lat", "lon").distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("dir")) for m in (250.0, 500.0, 1000.0) for d in "NESW")))
    moved = centres.withColumn("s", steps).select("lat", "lon", "s.*")
    moved = moved.withColumns(c.offset_point(F.col("lat"), F.col("lon"), F.col("m"), F.col("dir")))
    return centres.select("lat", "lon", F.lit(0.0).alias("m"), F.lit("C").alias("dir")).unionByName(moved)


@query("f01_keep_first", "geo", "select sample_id from (select sample_id, row_number() over (partition by lat, lon order by source, sample_id) as n from geo) where n = 1")
def f01(geo):
    return w.keep_first(geo, ["lat", "lon"], ["source", "sample_id"]).select("sample_id")


@query("f03_duplicate_flags", "geo", "select sample_id, count(*) over (partition by lat, lon) as n_same, count(*) over (partition by lat, lon) > 1 as repeated from geo")
def f03(geo):
    return w.multiplicity(geo, ["lat", "lon"]).select("sample_id", "n_same", (F.col("n_same") > 1).alias("repeated"))


@query("f06_average_rank", "paired", "select case_id, rank() over (order by balance) + (count(*) over (partition by balance) - 1) / 2 as rank from paired")
def f06(paired):
    return w.average_rank(paired.select("case_id", "balance"), "balance", []).select("case_id", "rank")


@query("f09_balanced_queue", "geo", """with o as (select * from (select *, row_number() over (partition by floor((lat + 90) / 0.5e0), floor((lon + 180) / 0.5e0) order by li desc, sample_id) as n from geo) where n = 1),
    p as (select * from (select *, row_number() over (partition by publication order by li desc, sample_id) as k from o) where k <= 2) select sample_id, source, turn::int as turn from (select *, row_number() over (partition by source order by li desc, sample_id) as turn from p) order by turn, source limit 60""")
def f09(geo):
    return w.round_robin(geo.withColumn("cell", c.cell("lat", "lon")), ["source"], [F.desc("li"), "sample_id"], 60, "cell", "publication", 2).select("sample_id", "source", "turn")


@query("f11_new_site_plan", "geo", "select sample_id from (select sample_id, row_number() over (partition by floor((lat + 90) / 0.5e0), floor((lon + 180) / 0.5e0) order by source, li desc, lat, sample_id) as n from geo) where n = 1")
def f11(geo):
    return w.keep_first(geo.withColumn("cell", c.cell("lat", "lon")), ["cell"], ["source", F.desc("li"), "lat", "sample_id"]).select("sample_id")


@query("g03_fold_thresholds", "oof", "select k.fold as train_fold, round(quantile_cont(o.li, 0.75), 6) as threshold from (select distinct fold from oof) k join oof o on o.fold <> k.fold group by k.fold")
def g03(oof):
    return f.fold_thresholds(oof, "li", 5)


@query("g04_fold_labels", "oof", "with t as (select k.fold, quantile_cont(o.li, 0.75) as t from (select distinct fold from oof) k join oof o on o.fold <> k.fold group by k.fold) select sample_id, (li >= t)::int as label from oof join t using (fold)")
def g04(oof):
    return f.fold_labels(oof, "li", 5).select("sample_id", "label")


@query("g01_group_folds", "oof", """with recursive_dummy as (select 1), s as (select cell, count(*) as n, row_number() over (order by count(*) desc, cell) as i from oof group by cell), r as (select 0::bigint as i, ''::varchar as cell, [0, 0, 0, 0, 0]::bigint[] as load, -1 as fold
    union all select s.i, s.cell, [case when x = list_position(r.load, list_min(r.load)) then r.load[x] + s.n else r.load[x] end for x in [1, 2, 3, 4, 5]]::bigint[], (list_position(r.load, list_min(r.load)) - 1)::int from r join s on s.i = r.i + 1) select cell, fold::int as fold from r where i > 0""")
def g01(oof):
    return f.group_folds(oof, "cell", 5)


@query("g06_embargo", "geo", f"""with l as (select sample_id, lat, lon, publication % 5 as fold from geo where source = 'purchase'), r as (select sample_id as r_id, lat as r_lat, lon as r_lon, publication % 5 as r_fold from geo where source = 'purchase')
    select sample_id, k.fold as test_fold from l, (select distinct publication % 5 as fold from geo) k where l.fold <> k.fold and not exists (select 1 from r where r.r_fold = k.fold and {HAV} <= 5e0)""")
def g06(geo):
    g = geo.where("source = 'purchase'").withColumn("fold", (F.col("publication") % 5).cast("int"))
    train = f.training_rows(g, 5).select("sample_id", "lat", "lon", F.col("train_fold").cast("bigint").alias("test_fold"))
    tests = g.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("fold").cast("bigint").alias("r_fold")).distinct()
    # cells first, folds after: pairs of one site repeat over folds alone
    near = j.radius_pairs(g.select("sample_id", "lat", "lon"), tests, 5.0).select("sample_id", F.col("r_fold").alias("test_fold")).distinct()
    return train.join(near, ["sample_id", "test_fold"], "left_anti").select("sample_id", "test_fold")


DRAW = "('0x' || substr(md5('b1|' || rep || '|' || k), 1, 8))::bigint"


@query("g08_cluster_bootstrap", "reg", f"""with s as (select grp, sum(abs(pred - y)) as e, count(*) as n, row_number() over (order by grp) - 1 as i from reg group by grp), d as (select rep, {DRAW} % (select count(*) from s) as i from range(100) t(rep), range((select count(*) from s)) u(k)),
    m as (select rep, sum(e) / sum(n) as mae from d join s using (i) group by rep) select count(*) as replicates, round(quantile_cont(mae, 0.025), 6) as low, round(quantile_cont(mae, 0.5), 6) as median, round(quantile_cont(mae, 0.975), 6) as high from m""")
def g08(reg):
    return f.bootstrap_mae(reg, "grp")


@query("g08_bootstrap_auc", "oof", f"""with s as (select cell, row_number() over (order by cell) - 1 as i from (select distinct cell from oof)), w as (select rep, i, count(*) as w from (select rep, {DRAW} % (select count(*) from s) as i from range(20) t(rep), range((select count(*) from s)) u(k)) group by 1, 2),
    d as (select rep, coarse as s, sum(w * y) as p, sum(w * (1 - y)) as q from w join s using (i) join oof using (cell) group by 1, 2), z as (select *, coalesce(sum(p) over (partition by rep order by s desc rows between unbounded preceding and 1 preceding), 0) as pa, coalesce(sum(q) over (partition by rep order by s desc rows between unbounded preceding and 1 preceding), 0) as qa from d)
    select rep::int as rep, round(sum(q * (pa + p / 2)) / (sum(p) * sum(q)), 6) as auc, round(sum(case when p > 0 then p * (pa + p) / (pa + p + qa + q) else 0 end) / sum(p), 6) as ap from z group by rep""")
def g08_auc(oof):
    return f.bootstrap_auc(oof, "cell", score="coarse")


@query("g09_group_subsample", "oof", "with g as (select cell, row_number() over (order by ('0x' || substr(md5('s1|' || cell), 1, 8))::bigint, cell) as place, count(*) over () as n from (select distinct cell from oof)) select sample_id from oof where cell in (select cell from g where place <= greatest(3, round(n * 0.25e0)))")
def g09(oof):
    return f.group_subset(oof, "cell", 0.25, "s1").select("sample_id")


@query("g12_site_weights", "geo", "with s as (select lat, lon, count(*) as n from geo group by 1, 2), m as (select count(*) / sum(n) as m from s) select sample_id, 1 / n / m as weight from geo join s using (lat, lon), m")
def g12(geo):
    g = geo.withColumn("site", c.site_id("lat", "lon"))
    return f.site_weights(g, "site").select("sample_id", "weight")


@query("g13_perturbations", "geo", "select sample_id, 'baseline' as scenario, li as value from geo union all select sample_id, 'missing', case when ('0x' || substr(md5('p1|' || sample_id), 1, 8))::bigint / 4294967296e0 >= 0.1e0 then li end from geo union all select sample_id, 'extreme', li * 3e0 from geo")
def g13(geo):
    return f.perturbed(geo, "li", "sample_id")


@query("g15_site_aggregation", "oof", "select cell, quantile_cont(li, 0.5) as li, (sum(y) * 2 > count(*))::int as label from oof group by cell having sum(y) * 2 <> count(*)")
def g15(oof):
    g = oof.groupBy("cell").agg(F.median("li").alias("li"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).where("2 * p <> n")
    return g.select("cell", "li", (2 * F.col("p") > F.col("n")).cast("int").alias("label"))


@query("j04_baselines", "oof", "select fold, count(*) as n, avg(abs(li - (select avg(o.li) from oof o where o.fold <> k.fold))) as mae from oof k group by fold")
def j04(oof):
    return f.baseline(oof, "li", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("li") - F.col("pred"))).alias("mae"))


@query("h01_source_union", "geo", "select sample_id, null::double as extra from geo where source = 'purchase' union all select sample_id, li from geo where source = 'signup'")
def h01(geo):
    return geo.where("source = 'purchase'").select("sample_id").unionByName(geo.where("source = 'signup'").select("sample_id", F.col("li").alias("extra")), allowMissingColumns=True)


@query("h02_key_difference", "geo", "select 'left' as side, count(*) as n from (select publication from geo where source = 'purchase' except select publication from geo where source = 'signup') union all select 'right', count(*) from (select publication from geo where source = 'signup' except select publication from geo where source = 'purchase')")
def h02(geo):
    a, b = (geo.where(F.col("source") == s).select("publication") for s in ("purchase", "signup"))
    n = lambda x, s: x.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(a.subtract(b), "left").unionByName(n(b.subtract(a), "right"))


@query("h03_key_intersection", "geo", "select publication from geo where source = 'purchase' intersect select publication from geo where source = 'signup'")
def h03(geo):
    return geo.where("source = 'purchase'").select("publication").intersect(geo.where("source = 'signup'").select("publication"))


@query("h04_tagged_union", "scen", "select 'a' as tag, count(*) as n from scen where season = 'summer' union all select 'b', count(*) from scen where season = 'winter'")
def h04(scen):
    tagged = scen.where("season = 'summer'").withColumn("tag", F.lit("a")).unionByName(scen.where("season = 'winter'").withColumn("tag", F.lit("b")))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
