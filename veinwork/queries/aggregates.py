"""Queries of filters, aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import aggregates as a
from veinwork.operators import metrics as m
from veinwork.operators import windows as w
from veinwork.operators.ordered import quantiles, with_quantiles

from .registry import query

MASKS = """m as (select *, SiO2 + TiO2 + Al2O3 + Fe2O3 + MnO + MgO + CaO + Na2O + K2O + P2O5 as t, 8 + (SiO2 is not null)::int + (Al2O3 is not null)::int as np,
  coalesce(SiO2, 0) + TiO2 + coalesce(Al2O3, 0) + Fe2O3 + MnO + MgO + CaO + Na2O + K2O + P2O5 as ps from oxides),
p as (select *, coalesce(measured_total between 94 and 102, false) as a, coalesce(coalesce(measured_total, t) between 94 and 102, false) as b,
  measured_total is null and t is null and SiO2 is not null and Al2O3 is not null and np >= 8 and Rb is not null and Sr is not null and ps between 70 and 102 and li is not null as cx from m)"""


def _masked(oxides: DataFrame) -> DataFrame:
    return a.protocol_masks(oxides, valid=F.col("li").isNotNull() & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


@query("c06_qc_protocols", "oxides", f"""with {MASKS} select sample_id, a as A_original, b as B_reconstructed, b or cx as C_experimental,
    case when cx then 'C_UNVERIFIED_EXPERIMENT_ONLY' when b and not a then 'B_COMPLETE_RECONSTRUCTION' when a then 'A_MEASURED_OR_PRECOMPUTED' else 'REJECTED' end as qc_status from p""")
def c06(oxides):
    return _masked(oxides).select("sample_id", "A_original", "B_reconstructed", "C_experimental", "qc_status")


@query("e08_protocol_summary", "oxides", f"""with {MASKS}, g as (select source, count(*) as total, count(*) filter (a) as na, count(*) filter (b) as nb, count(*) filter (b or cx) as nc from p group by source)
    select source, total, 'A_original' as protocol, na as rows, na - na as additional from g union all select source, total, 'B_reconstructed', nb, nb - na from g union all select source, total, 'C_experimental', nc, nc - na from g""")
def e08(oxides):
    return a.protocol_summary(_masked(oxides))


@query("c01_quality_control", "oxides", "select sample_id, measured_total from oxides where measured_total between 94 and 102")
def c01(oxides):
    return oxides.where(F.col("measured_total").between(94, 102)).select("sample_id", "measured_total")


@query("c02_target_validity", "oxides", "select count(*) as n, quantile_cont(li, 0.25) as q25, quantile_cont(li, 0.5) as q50, quantile_cont(li, 0.99) as q99 from oxides where li is not null")
def c02(oxides):
    valid = oxides.where("li is not null")
    return with_quantiles(valid.agg(F.count(F.lit(1)).alias("n")), [], quantiles(valid, [], F.col("li"), {"q25": 0.25, "q50": 0.5, "q99": 0.99}))


@query("c03_whole_rock", "raw", r"""with x as (select case when upper(trim(material)) = 'VOLCANIC GLASS' then 'GL' else nullif(regexp_extract(upper(trim(material)), '^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$', 1), '') end as code from raw)
    select count(*) filter (code = 'WR') as whole_rock, count(*) filter (code = 'GL') as glass, count(*) filter (code is null) as other from x""")
def c03(raw):
    code = c.material_code("material")
    return raw.agg(F.count_if(code == "WR").alias("whole_rock"), F.count_if(code == "GL").alias("glass"), F.count_if(code.isNull()).alias("other"))


@query("c04_coordinates", "geo", "select sample_id from geo where lon between -70 and 180 and lat between -28.5 and 90")
def c04(geo):
    return geo.where(F.col("lon").between(-70, 180) & F.col("lat").between(-28.5, 90)).select("sample_id")


@query("c05_minimum_predictors", "oxides", "select sample_id, ((SiO2 is not null)::int + (Al2O3 is not null)::int + (FeOT is not null)::int + (Rb is not null)::int)::int as n from oxides where (SiO2 is not null)::int + (Al2O3 is not null)::int + (FeOT is not null)::int + (Rb is not null)::int >= 3")
def c05(oxides):
    return oxides.withColumn("n", c.present("SiO2", "Al2O3", "FeOT", "Rb")).where("n >= 3").select("sample_id", "n")


@query("c07_eligibility_split", "geo", "select case when li between 0 and 150 and source <> 'click' then 'eligible' else 'excluded' end as part, count(*) as n from geo group by 1")
def c07(geo):
    ok = F.col("li").between(0, 150) & (F.col("source") != "click")
    return geo.groupBy(F.when(ok, "eligible").otherwise("excluded").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("c08_expansion_candidates", "geo", """with old as (select * from geo where source = 'purchase'), k as (select distinct 'g_' || floor((lat + 90) / 0.5e0)::bigint || '_' || floor((lon + 180) / 0.5e0)::bigint as cell from old), q as (select quantile_cont(li, 0.75) as q from old)
    select sample_id, li >= q as high from (select *, 'g_' || floor((lat + 90) / 0.5e0)::bigint || '_' || floor((lon + 180) / 0.5e0)::bigint as cell from geo where source <> 'purchase' and li <= 400), q where cell not in (select cell from k)""")
def c08(geo):
    g = geo.withColumn("cell", c.cell("lat", "lon"))
    old = g.where("source = 'purchase'")
    q = quantiles(old, [], F.col("li"), {"q": 0.75})
    return g.where("source <> 'purchase' and li <= 400").join(old.select("cell").distinct(), "cell", "left_anti").join(F.broadcast(q), how="inner").select("sample_id", (F.col("li") >= F.col("q")).alias("high"))


@query("c11_strata", "oof", "select subset, count(*) as n from (select 'all' as subset from oof union all select 'high' from oof where li >= 100 union all select 'fold0' from oof where fold = 0 union all select 'click' from oof where cohort = 'click') group by 1")
def c11(oof):
    return a.strata(oof, {"all": F.lit(True), "high": F.col("li") >= 100, "fold0": F.col("fold") == 0, "click": F.col("cohort") == "click"}).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("e01_stage_audit", "oxides", """select 'all' as stage, count(*) as rows, 20 as columns, sum((SiO2 is null)::int + (Al2O3 is null)::int + (measured_total is null)::int + (FeOT is null)::int + (Rb is null)::int + (Sr is null)::int + (li is null)::int)::bigint as missing from oxides
    union all select 'qc', count(*), 20, coalesce(sum((SiO2 is null)::int + (Al2O3 is null)::int + (measured_total is null)::int + (FeOT is null)::int + (Rb is null)::int + (Sr is null)::int + (li is null)::int), 0)::bigint from oxides where measured_total between 94 and 102""")
def e01(oxides):
    return a.stage_audit({"all": oxides, "qc": oxides.where(F.col("measured_total").between(94, 102))})


@query("e02_coordinate_diagnostics", "oxides", "select count(*) as rows, count(*) filter (lat between -90 and 90 and lon between -180 and 180) as valid, count(*) filter (lat is null or lon is null) as missing, count(*) filter (lat not between -90 and 90 or lon not between -180 and 180) as out_of_range, avg((lat between -90 and 90 and lon between -180 and 180)::int) as coverage from oxides")
def e02(oxides):
    return a.coordinate_diagnostics(oxides, "lat", "lon")


@query("e03_dataset_health", "oxides", "select count(*) as rows, count(li) as with_target, count(*) filter (li is not null and SiO2 is not null and Al2O3 is not null) as complete, count(*) - count(distinct (source, material)) as repeated from oxides")
def e03(oxides):
    d = a.duplicate_rows(oxides, ["source", "material"]).select(F.col("duplicates").alias("repeated"))
    return oxides.agg(F.count(F.lit(1)).alias("rows"), F.count("li").alias("with_target"), F.count_if(F.col("li").isNotNull() & F.col("SiO2").isNotNull() & F.col("Al2O3").isNotNull()).alias("complete")).join(d, how="inner")


@query("e04_schema_profile", "raw", "with l as (select 'material' as feature, material as value from raw union all select 'age', age from raw union all select 'comment', comment from raw), g as (select feature, value, count(*) as n from l where value is not null group by 1, 2) select feature, value, n, place::int as place from (select *, row_number() over (partition by feature order by n desc, value) as place from g) where place <= 3")
def e04(raw):
    return a.top_values(raw, ["material", "age", "comment"], 3)


@query("e05_feature_manifest", "raw", "with l as (select 'rock' as feature, rock as value from raw union all select 'lon_a', lon_a from raw union all select 'value', value from raw) select feature, (count(*) - count(value))::bigint as missing, (count(*) - count(value)) / count(*) as missing_fraction, count(distinct value) as distinct_values from l group by 1")
def e05(raw):
    return a.feature_manifest(raw, ["rock", "lon_a", "value"])


@query("e06_source_counts", "raw", "select coalesce(rock, 'unknown') as source, count(*) as n from raw group by 1")
def e06(raw):
    return raw.groupBy(F.coalesce("rock", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("e07_preflight_duplicates", "geo", "select sum(n)::bigint as rows, count(*) as distinct_rows, (sum(n) - count(*))::bigint as duplicates from (select lat, lon, count(*) as n from geo group by 1, 2)")
def e07(geo):
    return a.duplicate_rows(geo, ["lat", "lon"])


@query("e09_site_summary", "geo", "select lat, lon, count(*) as n, count(distinct publication) as publications, count(*) filter (li >= 100) as n_high, min((li >= 100)::int) <> max((li >= 100)::int) as mixed from geo group by lat, lon")
def e09(geo):
    high = (F.col("li") >= 100).cast("int")
    return geo.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("publication").alias("publications"), F.sum(high).alias("n_high"), (F.min(high) != F.max(high)).alias("mixed"))


@query("e11_conflicting_labels", "geo", "select lat, lon, min(li) as low, max(li) as high, array_to_string(list_sort(list_distinct(list(source))), ';') as sources from geo group by lat, lon having min((li >= 100)::int) <> max((li >= 100)::int)")
def e11(geo):
    high = (F.col("li") >= 100).cast("int")
    g = geo.groupBy("lat", "lon").agg(F.min("li").alias("low"), F.max("li").alias("high"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), (F.min(high) != F.max(high)).alias("mixed"))
    return g.where("mixed").drop("mixed")


@query("e12_irreducible_error", "oof", "select fold, sum(least(p, n))::bigint as errors, sum(p + n)::bigint as rows from (select fold, coarse, cell, sum(y) as p, sum(1 - y) as n from oof group by 1, 2, 3) group by fold")
def e12(oof):
    g = oof.groupBy("fold", "coarse", "cell").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return g.groupBy("fold").agg(F.sum(F.least("p", "n")).alias("errors"), F.sum(F.col("p") + F.col("n")).alias("rows"))


@query("e13_group_coverage", "oof", "select cell, count(*) as n, sum(y)::bigint as positives, quantile_cont(li, 0.5) as median_li, min(fine) as low, max(fine) as high from oof group by cell")
def e13(oof):
    return oof.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"), F.median("li").alias("median_li"), F.min("fine").alias("low"), F.max("fine").alias("high"))


@query("e14_concentration", "oof", "with g as (select cell, count(*) as n from oof group by cell) select count(*) as groups, count(*) filter (n = 1) as singletons, max(n) / sum(n) as top1_share, (select sum(n) from (select n from g order by n desc, cell limit 5)) / sum(n) as top5_share, sum(n) * sum(n) / sum(n * n)::double as effective_groups from g")
def e14(oof):
    return a.concentration(oof, "cell")


@query("e15_fold_imbalance", "oof", "select fold, sum(n)::bigint as n, count(*) as groups, sum(p) / sum(n) as rate, max(n) / sum(n) as largest from (select fold, cell, count(*) as n, sum(y) as p from oof group by 1, 2) group by fold")
def e15(oof):
    g = oof.groupBy("fold", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    return g.groupBy("fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), (F.sum("p") / F.sum("n")).alias("rate"), (F.max("n") / F.sum("n")).alias("largest"))


REG = """count(*) as n, round(sqrt(avg((pred - y) * (pred - y))), 6) as rmse, round(avg(abs(pred - y)), 6) as mae, round(quantile_cont(abs(pred - y), 0.5), 6) as median_ae, round(quantile_cont(abs(pred - y), 0.9), 6) as p90_ae, round(avg(pred - y), 6) as bias,
    round(1 - avg((pred - y) * (pred - y)) / var_pop(y), 6) as r2, round(1 - var_pop(pred - y) / var_pop(y), 6) as explained"""


@query("e16_regression_metrics", "reg", f"select {REG} from reg")
def e16(reg):
    return m.regression(reg, [])


@query("e22_group_metrics", "reg", f"select grp, {REG} from reg group by grp")
def e22(reg):
    return m.regression(reg, ["grp"])


@query("e28_source_metrics", "reg", f"select source, {REG} from reg group by source")
def e28(reg):
    return m.regression(reg, ["source"])


@query("e41_fold_mean_std", "reg", "select avg(mae) as mean_mae, stddev_pop(mae) as std_mae from (select fold, avg(abs(pred - y)) as mae from reg group by fold)")
def e41(reg):
    return m.regression(reg, ["fold"]).agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"))


@query("e45_residual_q90", "reg", "select round(quantile_cont(abs(pred - y), 0.9), 6) as q90 from reg")
def e45(reg):
    return quantiles(reg, [], F.abs(F.col("pred") - F.col("y")), {"q90": 0.9})


@query("f19_error_share", "reg", "with s as (select (pred - y) * (pred - y) as e, grp from reg) select t.n::int as top, round((select sum(e) from (select e from s order by e desc, grp limit 1)) / (select sum(e) from s), 6) as share from (select 1 as n) t union all select 10, round((select sum(e) from (select e from s order by e desc, grp limit 10)) / (select sum(e) from s), 6)")
def f19(reg):
    return w.error_share(reg, F.col("pred") - F.col("y"), (1, 10), "grp")


@query("e27_band_metrics", "reg", """with q as (select quantile_cont(y, 0.25) as a, quantile_cont(y, 0.5) as b, quantile_cont(y, 0.75) as c from reg) select case when y <= a then 0 when y <= b then 1 when y <= c then 2 else 3 end as band, count(*) as n, round(avg(abs(pred - y)), 6) as mae from reg, q group by 1""")
def e27(reg):
    edges = quantiles(reg, [], F.col("y"), {"a": 0.25, "b": 0.5, "c": 0.75})
    band = F.when(F.col("y") <= F.col("a"), 0).when(F.col("y") <= F.col("b"), 1).when(F.col("y") <= F.col("c"), 2).otherwise(3)
    return m.regression(reg.join(F.broadcast(edges), how="inner").withColumn("band", band), ["band"]).select("band", "n", "mae")


CONF = """n, tp, fp, fn, tn, brier, prevalence, "precision", recall, specificity, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, (recall + specificity) / 2 as balanced_accuracy from (select *,
    case when tp + fp > 0 then tp / (tp + fp) else 0 end as "precision", case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when tn + fp > 0 then tn / (tn + fp) else 0 end as specificity from (select {k} count(*) as n,
    count(*) filter (fine >= 0.5e0 and y = 1) as tp, count(*) filter (fine >= 0.5e0 and y = 0) as fp, count(*) filter (fine < 0.5e0 and y = 1) as fn, count(*) filter (fine < 0.5e0 and y = 0) as tn, avg((fine - y) * (fine - y)) as brier, avg(y) as prevalence from oof {g}))"""


@query("e17_binary_metrics", "oof", "select " + CONF.format(k="", g=""))
def e17(oof):
    return m.confusion(oof, [], 0.5, score="fine")


@query("e23_stratified_metrics", "oof", "select cohort, " + CONF.format(k="cohort,", g="group by cohort"))
def e23(oof):
    return m.confusion(oof, ["cohort"], 0.5, score="fine")


RANK = """with d as (select {k} {s} as s, sum(y) as p, count(*) - sum(y) as q from oof group by {k} {s}), z as (select *, coalesce(sum(p) over (partition by {pk} order by s desc rows between unbounded preceding and 1 preceding), 0) as pa,
    coalesce(sum(q) over (partition by {pk} order by s desc rows between unbounded preceding and 1 preceding), 0) as qa from d)
    select {k} round(sum(q * (pa + p / 2)) / (sum(p) * sum(q)), 6) as auc, round(sum(p * (pa + p) / (pa + p + qa + q)) / sum(p), 6) as ap from z {g}"""


@query("e18_e19_auc_ap_fine", "oof", RANK.format(k="", pk="1", s="fine", g=""))
def e18(oof):
    return m.ranking(oof, [], score="fine")


@query("e18_e19_auc_ap_ties", "oof", RANK.format(k="", pk="1", s="coarse", g=""))
def e18_ties(oof):
    return m.ranking(oof, [], score="coarse")


@query("e18_e19_auc_ap_by_cohort", "oof", RANK.format(k="cohort,", pk="cohort", s="fine", g="group by cohort"))
def e18_cohort(oof):
    return m.ranking(oof, ["cohort"], score="fine")


@query("e20_reliability", "oof", "select least(floor(fine * 10), 9)::int as bin, count(*) as n, avg(fine) as mean_score, avg(y) as rate, avg(y) - avg(fine) as gap from oof group by 1")
def e20(oof):
    return m.reliability(oof, [], score="fine")


@query("e21_calibration_error", "oof", "select sum(n * abs(g)) / sum(n) as ece from (select count(*) as n, avg(y) - avg(fine) as g from oof group by least(floor(fine * 10), 9))")
def e21(oof):
    return m.calibration_error(oof, [], score="fine")


@query("f13_operating_threshold", "oof", """with d as (select coarse as s, sum(y) as p, count(*) - sum(y) as q from oof group by 1), n as (select s, lead(s) over (order by s) as nx from d), t as (select distinct t from (select s as t from n union all select (s + nx) / 2 from n where nx is not null union all select unnest([0e0, 0.5e0, 1e0]))),
    m as (select t, sum(case when coarse >= t and y = 1 then 1 else 0 end) as tp, sum(case when coarse >= t and y = 0 then 1 else 0 end) as fp, sum(y) as p, sum(1 - y) as q from t, oof group by t),
    k as (select t, round((tp / p + 1 - fp / q) / 2, 12) as ba, round(2 * tp / (p + tp + fp), 12) as f1, round(tp / p, 12) as rec from m)
    select t as threshold, round(ba, 6) as balanced_accuracy, round(f1, 6) as f1, round(rec, 6) as recall from k order by ba desc, k.f1 desc, rec desc, round(abs(t - 0.5e0), 12), t limit 1""")
def f13(oof):
    return m.operating_threshold(oof, [], score="coarse")


@query("e24_site_evaluation", "oof", "with s as (select cell, quantile_cont(li, 0.5) as li, quantile_cont(fine, 0.5) as score, min(y) <> max(y) as mixed from oof group by cell) select mixed, count(*) as n, avg((score - (li >= 50)::int) * (score - (li >= 50)::int)) as brier from s group by mixed")
def e24(oof):
    s = oof.groupBy("cell").agg(F.median("li").alias("li"), F.median("fine").alias("score"), (F.min("y") != F.max("y")).alias("mixed")).withColumn("y", (F.col("li") >= 50).cast("int"))
    return m.confusion(s, ["mixed"]).select("mixed", "n", "brier")


@query("e25_leave_one_out", "oof", "with t as (select fold, count(*) as n, sum(abs(fine - y)) as e from oof group by fold) select fold, ((select sum(e) from t) - e) / ((select sum(n) from t) - n) as mae_without from t")
def e25(oof):
    t = oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("fine") - F.col("y"))).alias("e"))
    return t.select("fold", ((F.sum("e").over(Window.partitionBy()) - F.col("e")) / (F.sum("n").over(Window.partitionBy()) - F.col("n"))).alias("mae_without"))


@query("e26_coverage_bias", "scen", "select score is not null as scored, count(*) as n, count(distinct region) as regions from scen group by 1")
def e26(scen):
    return scen.groupBy(F.col("score").isNotNull().alias("scored")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("region").alias("regions"))


@query("e29_distribution", "geo", "select source, count(li) as n, quantile_cont(li, 0.5) as median, quantile_cont(li, 0.75) as q75, quantile_cont(li, 0.9) as q90, quantile_cont(li, 0.95) as q95, quantile_cont(li, 0.99) as q99, max(li) as max, stddev_pop(li) as std, count(*) filter (li > 50) as over_50, count(*) filter (li > 100) as over_100 from geo group by source")
def e29(geo):
    return a.distribution(geo, "li", ["source"], (50.0, 100.0))


@query("e30_scenario_summary", "scen", "select campaign, season, count(score) as scored, count(*) - count(score) as abstained, avg(score) as mean, quantile_cont(score, 0.5) as median, stddev_samp(score) as std, quantile_cont(score, 0.9) as p90, max(score) as max from scen group by 1, 2")
def e30(scen):
    g = scen.groupBy("campaign", "season").agg(F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("abstained"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.max("score").alias("max"))
    return with_quantiles(g, ["campaign", "season"], quantiles(scen, ["campaign", "season"], F.col("score"), {"median": 0.5, "p90": 0.9}))


@query("e32_interannual", "scen", "select region, count(*) as years, avg(s) as mean, min(s) as low, max(s) as high, stddev_pop(s) as std, max(s) - min(s) as range from (select region, year, avg(score) as s from scen group by 1, 2) group by region")
def e32(scen):
    y = scen.groupBy("region", "year").agg(F.avg("score").alias("s"))
    return y.groupBy("region").agg(F.count(F.lit(1)).alias("years"), F.avg("s").alias("mean"), F.min("s").alias("low"), F.max("s").alias("high"), F.stddev_pop("s").alias("std"), (F.max("s") - F.min("s")).alias("range"))


@query("e33_seasonal_pivot", "scen", "select region, year, avg(score) filter (season = 'summer') as summer, avg(score) filter (season = 'winter') as winter, avg(score) filter (season = 'winter') - avg(score) filter (season = 'summer') as shift from scen group by 1, 2")
def e33(scen):
    return scen.groupBy("region", "year").pivot("season", ["summer", "winter"]).agg(F.avg("score")).withColumn("shift", F.col("winter") - F.col("summer"))


@query("e34_within_season", "scen", "select region, season, count(*) as scenes, count(distinct id % 50) as distinct_scenes, stddev_pop(score) as spread from scen group by 1, 2")
def e34(scen):
    return scen.groupBy("region", "season").agg(F.count(F.lit(1)).alias("scenes"), F.countDistinct(F.col("id") % 50).alias("distinct_scenes"), F.stddev_pop("score").alias("spread"))


@query("e35_campaign_inventory", "scen", "select campaign, count(*) as total, count(score) as scored, count(*) filter (score is null and season = 'winter') as expected_abstained, count(*) filter (score is null and season <> 'winter') as unexpected from scen group by 1")
def e35(scen):
    no = F.col("score").isNull()
    return scen.groupBy("campaign").agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("scored"), F.count_if(no & (F.col("season") == "winter")).alias("expected_abstained"), F.count_if(no & (F.col("season") != "winter")).alias("unexpected"))


@query("d15_baseline_shift", "scen", "with b as (select region, avg(score) as b from scen where year = 2020 group by region) select region, year, avg(score) - any_value(b) as shift from scen join b using (region) group by region, year")
def d15(scen):
    base = scen.where("year = 2020").groupBy("region").agg(F.avg("score").alias("b"))
    return scen.groupBy("region", "year").agg(F.avg("score").alias("s")).join(base, "region").select("region", "year", (F.col("s") - F.col("b")).alias("shift"))


@query("f05_year_shift", "scen", "select region, year, s, s - lag(s) over (partition by region order by year) as change from (select region, year, avg(score) as s from scen group by 1, 2)")
def f05(scen):
    return w.change(scen.groupBy("region", "year").agg(F.avg("score").alias("s")), ["region"], "year", "s")


@query("e37_correlations", "paired", "with r as (select predicted, balance, rank() over (order by predicted) + (count(*) over (partition by predicted) - 1) / 2 as ra, rank() over (order by balance) + (count(*) over (partition by balance) - 1) / 2 as rb from paired) select 'predicted' as first, 'balance' as second, count(*) as n, corr(predicted, balance) as pearson, corr(ra, rb) as spearman from r")
def e37(paired):
    return a.correlations(paired, [("predicted", "balance")], "case_id")


@query("e46_applicability_profile", "oxides", "select round(quantile_cont(CaO, 0.01), 6) as lo_CaO, round(quantile_cont(CaO, 0.99), 6) as hi_CaO, round(quantile_cont(Al2O3, 0.01), 6) as lo_Al2O3, round(quantile_cont(Al2O3, 0.99), 6) as hi_Al2O3 from oxides")
def e46(oxides):
    return a.profile(oxides, ["CaO", "Al2O3"])


@query("e44_prevalence_threshold", "oof", "with p as (select avg(y) as p from oof), r as (select fine, row_number() over (order by fine) - 1 as i, count(*) over () as n from oof) select round(min(case when i = floor((n - 1) * (1 - p)) then fine end) + (max(case when i = ceil((n - 1) * (1 - p)) then fine end) - min(case when i = floor((n - 1) * (1 - p)) then fine end)) * ((any_value(n) - 1) * (1 - any_value(p)) - floor((any_value(n) - 1) * (1 - any_value(p)))), 6) as threshold from r, p")
def e44(oof):
    from veinwork.operators.decisions import prevalence_threshold

    return prevalence_threshold(oof, "y", "fine")


@query("e47_iron_consistency", "oxides", "select count(FeOT) as both, quantile_cont(FeOT * 1.111348 / Fe2O3, 0.5) as median_ratio, count(*) filter (FeOT * 1.111348 < Fe2O3) as below from oxides")
def e47(oxides):
    r = F.col("FeOT") * c.IRON_FACTOR / F.col("Fe2O3")
    g = oxides.agg(F.count("FeOT").alias("both"), F.count_if(F.col("FeOT") * c.IRON_FACTOR < F.col("Fe2O3")).alias("below"))
    return with_quantiles(g, [], quantiles(oxides, [], r, {"median_ratio": 0.5}))


@query("e48_sample_in_cells", "geo", "select publication, count(distinct floor((lat + 90) / 5e0)::int * 1000 + floor((lon + 180) / 5e0)::int) as cells from geo group by publication having count(distinct floor((lat + 90) / 5e0)::int * 1000 + floor((lon + 180) / 5e0)::int) > 1")
def e48(geo):
    return geo.groupBy("publication").agg(F.countDistinct(c.cell("lat", "lon", 5.0)).alias("cells")).where("cells > 1")


@query("e42_group_medians", "oof", "select fold, cell, quantile_cont(li, 0.5) as median_li, max(fine) as best from oof group by fold, cell")
def e42(oof):
    return oof.groupBy("fold", "cell").agg(F.median("li").alias("median_li"), F.max("fine").alias("best"))
