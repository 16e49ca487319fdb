"""Queries of composite audits and studies over the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import decisions as d
from veinwork.operators import folds as f
from veinwork.operators.ordered import numbered, quantiles, running

from .registry import query


@query("e10_policy_counts", "raw", """with s as (select case when upper(verification) in ('FIELD_VERIFIED_SURFACE', 'GPS_AND_SURFACE_VERIFIED') then 'verified' when regexp_matches(upper(verification), 'EXCLUDE|SUBSURFACE|DRILL_CORE|INVALID') then 'excluded'
    when upper(verification) in ('PRE_SCREENED_NOT_FIELD_VERIFIED', 'PROVISIONAL_SITE_REVIEW') then 'provisional' when dataset like 'GEOROC_B_SURFACE_PROVISIONAL%' then 'provisional' else 'historical' end as status, rock from raw) select status, count(*) as n, count(*) filter (rock is null) as without_rock from s group by 1""")
def e10(raw):
    return raw.groupBy(c.eligibility("verification", "dataset").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rock").isNull()).alias("without_rock"))


@query("e36_batch_summary", "scen", "select count(*) as n, count(score) as scored, avg(score) as mean, count(*) filter (score >= 0.7e0) as high from scen")
def e36(scen):
    return scen.agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.avg("score").alias("mean"), F.count_if(F.col("score") >= 0.7).alias("high"))


@query("e38_correlation_matrix", "oxides", "select 'CaO' as a, 'MgO' as b, corr(CaO, MgO) as r from oxides union all select 'CaO', 'K2O', corr(CaO, K2O) from oxides union all select 'MgO', 'K2O', corr(MgO, K2O) from oxides")
def e38(oxides):
    pairs = [("CaO", "MgO"), ("CaO", "K2O"), ("MgO", "K2O")]
    return oxides.agg(*(F.corr(*p).alias(f"r{i}") for i, p in enumerate(pairs))).select(F.inline(F.array(*(F.struct(F.lit(p[0]).alias("a"), F.lit(p[1]).alias("b"), F.col(f"r{i}").alias("r")) for i, p in enumerate(pairs)))))


@query("g05_anchored_folds", "oof", "with o as (select distinct cell, fold from oof where cohort = 'click'), n as (select distinct cell from oof where cell not in (select cell from o)) select cell, min(fold)::int as fold from o group by cell union all select cell, ((row_number() over (order by cell) - 1) % 5)::int from n")
def g05(oof):
    old = oof.where("cohort = 'click'").groupBy("cell").agg(F.min("fold").alias("fold"))
    new = oof.select("cell").distinct().join(old, "cell", "left_anti")
    return old.unionByName(numbered(new, ["cell"], "place").select("cell", (F.col("place") % 5).cast("int").alias("fold")))


@query("g10_repeated_holdout", "oof", "with k as (select cell, rep, row_number() over (partition by rep order by ('0x' || substr(md5('h|' || rep || '|' || cell), 1, 8))::bigint, cell) as place, count(*) over (partition by rep) as n from (select distinct cell from oof), range(3) t(rep)) select rep::int as rep, cell from k where place <= ceil(n * 0.2e0)")
def g10(oof):
    cells = oof.select("cell").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drawn = cells.withColumn("draw", f.draw("h", F.col("rep"), F.col("cell"))).withColumn("one", F.lit(1))
    return running(drawn, ["rep"], ["draw", "cell"], "one", "place", "n").where("place < ceil(n * 0.2)").select("rep", "cell")


@query("g11_three_candidates", "oof", """with s as (select fold, cell, quantile_cont(li, 0.5) as li, quantile_cont(fine, 0.5) as score from oof group by 1, 2), p as (select s.*, t.k, row_number() over (partition by fold, k order by ('0x' || substr(md5('t|' || k || '|' || cell), 1, 8))::bigint, cell) as place from s, range(20) t(k)),
    g as (select fold, k, count(*) as n, arg_max(cell, li) as best, arg_max(cell, score) as pick, count(distinct li) as d, count(distinct score) as e from p where place <= 3 group by 1, 2) select fold, count(*) as triples, avg((best = pick)::int) as top1 from g where n = 3 and d = 3 and e = 3 group by fold""")
def g11(oof):
    sites = oof.groupBy("fold", "cell").agg(F.median("li").alias("li"), F.median("fine").alias("score")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    place = F.row_number().over(Window.partitionBy("fold", "k").orderBy(f.draw("t", F.col("k"), F.col("cell")), "cell"))
    g = sites.withColumn("place", place).where("place <= 3").groupBy("fold", "k").agg(F.count(F.lit(1)).alias("n"), F.max_by("cell", "li").alias("best"), F.max_by("cell", "score").alias("pick"), F.countDistinct("li").alias("d"), F.countDistinct("score").alias("e"))
    return g.where("n = 3 and d = 3 and e = 3").groupBy("fold").agg(F.count(F.lit(1)).alias("triples"), F.avg((F.col("best") == F.col("pick")).cast("int")).alias("top1"))


@query("g16_augmented_union", "oxides", "select sample_id, 1e0 as weight, CaO from oxides union all select sample_id, 0.5e0, CaO * (0.95e0 + 0.1e0 * (('0x' || substr(md5('g|' || sample_id), 1, 8))::bigint / 4294967296e0)) from oxides")
def g16(oxides):
    gain = 0.95 + 0.1 * (f.draw("g", F.col("sample_id")) / float(1 << 32))
    return oxides.select("sample_id", F.lit(1.0).alias("weight"), "CaO").unionByName(oxides.select("sample_id", F.lit(0.5).alias("weight"), (F.col("CaO") * gain).alias("CaO")))


@query("k13_readiness", "oof", "select cohort, array_to_string(list_filter([case when count(*) < 150 then 'enough_rows' end, case when sum(y) < 40 then 'enough_positives' end, case when count(distinct cell) < 10 then 'enough_cells' end], lambda z: z is not null), ',') as reasons from oof group by cohort")
def k13(oof):
    g = oof.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.countDistinct("cell").alias("cells"))
    return g.select("cohort", d.reasons(enough_rows=F.col("n") >= 150, enough_positives=F.col("p") >= 40, enough_cells=F.col("cells") >= 10).alias("reasons"))


@query("k14_review_worklist", "raw", "select id, case when comment like 'DRILL CORE%' then '1_exclude' when lat_text is null then '2_locate' when rock is null or trim(rock) = '' then '3_describe' end as action from raw where comment like 'DRILL CORE%' or lat_text is null or rock is null or trim(rock) = ''")
def k14(raw):
    action = F.when(F.col("comment").startswith("DRILL CORE"), "1_exclude").when(F.col("lat_text").isNull(), "2_locate").when(F.col("rock").isNull() | (F.trim("rock") == ""), "3_describe")
    return raw.select("id", action.alias("action")).where("action is not null")


@query("n28_threshold_study", "oof", "with t as (select k.fold, quantile_cont(o.fine, 0.8) as t from (select distinct fold from oof) k join oof o on o.fold <> k.fold group by k.fold) select fold, avg(((fine >= t)::int = y)::int) as accuracy, avg(((fine >= 0.5e0)::int = y)::int) as at_half from oof join t using (fold) group by fold")
def n28(oof):
    t = f.training_rows(oof, 5).transform(lambda x: quantiles(x, ["train_fold"], F.col("fine"), {"t": 0.8})).withColumnRenamed("train_fold", "fold")
    right = lambda x: F.avg(((F.col("fine") >= x).cast("int") == F.col("y")).cast("int"))
    return oof.join(t, "fold").groupBy("fold").agg(right(F.col("t")).alias("accuracy"), right(F.lit(0.5)).alias("at_half"))
