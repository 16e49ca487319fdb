"""Queries of decisions, gates and composite studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.operators import decisions as d
from veinwork.operators import metrics as m
from veinwork.operators import windows as w
from veinwork.operators.ordered import quantiles

from .registry import query


@query("f07_leaderboard", "scen", "with g as (select campaign, avg(score) as s, count(*) as n from scen group by 1) select campaign, s, case when campaign <> 'click' then row_number() over (partition by campaign <> 'click' order by s desc, campaign) end::int as rank from g")
def f07(scen):
    g = scen.groupBy("campaign").agg(F.avg("score").alias("s"))
    return w.leaderboard(g, [F.desc("s"), "campaign"], F.col("campaign") != "click").select("campaign", "s", "rank")


@query("f08_two_stage_decision", "paired", "with t as (select case_id, score from paired order by predicted desc, case_id limit 3) select 'decided' as status, case_id as winner, (select count(*) from paired) as valid from t order by score desc, case_id limit 1")
def f08(paired):
    return d.two_stage(paired, "case_id", "predicted", "score", "low_q90")


@query("f16_top_changes", "scen", "select id, score from scen where score is not null order by score desc, id limit 25")
def f16(scen):
    return w.top(scen.where("score is not null").select("id", "score"), 25, F.desc("score"), F.col("id"))


@query("f17_best_scene", "scen", "select region, id from (select region, id, row_number() over (partition by region, year order by score desc nulls last, season, id) as n from scen) where n = 1")
def f17(scen):
    return w.keep_first(scen, ["region", "year"], [F.desc_nulls_last("score"), "season", "id"]).select("region", "id")


@query("f15_grid_threshold", "oof", "with q as (select unnest(quantile_cont(coarse, [0.05, 0.25, 0.5, 0.75, 0.95])) as t from oof), m as (select t, sum((coarse >= t and y = 1)::int) / sum(y) as r, sum((coarse < t and y = 0)::int) / sum(1 - y) as s from oof, (select distinct t from q) group by t) select t as threshold, round((r + s) / 2, 6) as balanced_accuracy from m order by round((r + s) / 2, 12) desc, t limit 1")
def f15(oof):
    shares = {f"q{i}": q for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))}
    grid = quantiles(oof, [], F.col("coarse"), shares).select(F.array_distinct(F.array(*shares)).alias("ts"))
    c = m.confusion(oof.join(F.broadcast(grid), how="inner").withColumn("t", F.explode("ts")), ["t"], F.col("t"), score="coarse")
    return c.orderBy(F.desc(F.round("balanced_accuracy", 12)), "t").limit(1).select(F.col("t").alias("threshold"), "balanced_accuracy")


@query("k02_group_isolation", "oof", "select cell, count(distinct fold) as folds from oof group by cell having count(distinct fold) > 1")
def k02(oof):
    return d.isolated(oof, "cell")


@query("k05_complete_once", "oof", "select sample_id, (case when cohort = 'click' then 2 else 0 end)::bigint as times from oof where cohort in ('click', 'view')")
def k05(oof):
    tested = oof.where("cohort <> 'view'").select("sample_id").unionByName(oof.where("cohort = 'click'").select("sample_id"))
    return d.complete_once(oof, tested, "sample_id")


@query("k06_same_protocol", "oof", "select count(*) as rows, count(*) filter (abs(fine - coarse) > 0.5e0) as differing from oof")
def k06(oof):
    j = oof.select("sample_id", "fine").join(oof.select("sample_id", "coarse"), "sample_id", "full")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("fine") - F.col("coarse")) > 0.5).alias("differing"))


@query("k08_independence_gate", "oof", """with g as (select count(*) as cases, sum(y)::bigint as positives, count(*) filter (li > 400) as duplicates, count(*) filter (fold = 9) as near from oof)
    select *, array_to_string(list_filter([case when cases < 50 then 'enough_cases' end, case when positives < 10 then 'enough_positives' end, case when duplicates > 0 then 'no_duplicates' end, case when near > 0 then 'none_near' end], lambda z: z is not null), ',') as reasons, cases >= 50 and positives >= 10 and duplicates = 0 and near = 0 as approved from g""")
def k08(oof):
    return d.independence_gate(oof, "y", F.col("li") > 400, F.col("fold") == 9)


@query("k10_candidate_gate", "oof", """with a as (select cohort, avg((fine >= 0.5e0)::int = y) as acc, avg((fine - y) * (fine - y)) as brier, avg((coarse >= 0.5e0)::int = y) as acc2, avg((coarse - y) * (coarse - y)) as brier2 from (select *, 1 as one from oof) group by cohort)
    select cohort, array_to_string(list_filter([case when acc2 < acc then 'acc' end, case when brier2 > brier then 'brier' end], lambda z: z is not null), ',') as reasons, greatest(acc2 - acc, brier - brier2) > 0 as better, acc2 >= acc and brier2 <= brier and greatest(acc2 - acc, brier - brier2) > 0 as approved from a""".replace("avg((fine >= 0.5e0)::int = y)", "avg(((fine >= 0.5e0)::int = y)::int)").replace("avg((coarse >= 0.5e0)::int = y)", "avg(((coarse >= 0.5e0)::int = y)::int)"))
def k10(oof):
    side = lambda s: oof.groupBy("cohort").agg(F.avg(((F.col(s) >= 0.5).cast("int") == F.col("y")).cast("int")).alias("acc"), F.avg((F.col(s) - F.col("y")) * (F.col(s) - F.col("y"))).alias("brier"))
    return d.candidate_gate(side("fine"), side("coarse"), ["cohort"], ["acc"], ["brier"])


@query("n10_arms_against_reference", "oof", "select fold, avg((fine - y) * (fine - y)) as brier, avg((coarse - y) * (coarse - y)) - avg((fine - y) * (fine - y)) as delta from oof group by fold")
def n10(oof):
    a, b = (m.confusion(oof, ["fold"], score=s).select("fold", F.col("brier").alias(f"b_{s}")) for s in ("fine", "coarse"))
    return a.join(b, "fold").select("fold", F.col("b_fine").alias("brier"), (F.col("b_coarse") - F.col("b_fine")).alias("delta"))
