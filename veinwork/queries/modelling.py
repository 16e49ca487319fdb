"""Queries of model fitting. Least squares of one number is SQL, too; trees aren't, and are checked by rows and by tests."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from veinwork.operators import aggregates as a
from veinwork.operators import decisions as d
from veinwork.operators import metrics as m
from veinwork.operators.ordered import quantiles
from veinwork.plans import modelling as ml

from .registry import query

NUMERIC = ["TiO2", "Fe2O3", "MnO", "MgO", "CaO", "Na2O", "K2O", "P2O5"]


def _samples(oxides):
    return oxides.withColumn("fold", (F.col("sample_id") % 3).cast("int")).withColumn("target", F.col("CaO") * 2 + F.col("MgO") + F.coalesce("SiO2", F.lit(40.0)) / 10)


@query("j02_regression_competition", "oxides")
def j02(oxides):
    return ml.competition(_samples(oxides), "sample_id", "target", ml.preprocessor([*NUMERIC, "SiO2"], ["source"]), 3, "regression").select("algorithm", "fold", "n", "rmse", "mae", "r2")


@query("j03_classifier_leaderboard", "oxides")
def j03(oxides):
    df = _samples(oxides).withColumn("y", (F.col("target") >= 16).cast("double"))
    est = {"logistic": ml.estimators("classification", "y")["logistic"], "boosted_trees": ml.estimators("classification", "y")["boosted_trees"]}
    folds = None
    for name, e in est.items():
        r = m.ranking(ml.out_of_fold(df, "sample_id", "y", ml.preprocessor(NUMERIC), e, 3, "classification"), ["fold"]).withColumn("algorithm", F.lit(name))
        folds = r if folds is None else folds.unionByName(r)
    return ml.leaderboard(folds, "auc", ascending=False)


@query("j10_importances", "oxides")
def j10(oxides):
    return ml.importances(_samples(oxides), "sample_id", "target", NUMERIC, 5)


@query("j11_f_statistics", "oxides", """with l as (select (CaO >= 4)::int as y, unnest([{'f': 'MgO', 'v': MgO}, {'f': 'K2O', 'v': K2O}, {'f': 'SiO2', 'v': SiO2}]) as x from oxides), g as (select x.f as feature, y, count(*) as n, avg(x.v) as m, var_pop(x.v) as s from l where x.v is not null group by 1, 2)
    select feature, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 4) as f from g group by 1""")
def j11(oxides):
    f = ml.f_statistics(oxides.withColumn("y", (F.col("CaO") >= 4).cast("int")), "y", ["MgO", "K2O", "SiO2"])
    return f.select("feature", F.round("f", 4).alias("f"))


_S = "s as (select *, (sample_id % 3)::int as fold, CaO * 2 + MgO + coalesce(SiO2, 40e0) / 10 as target from oxides)"
_ONE = {"lime": ["CaO"], "magnesia": ["MgO"], "potash": ["K2O"]}
_X = "x as (select sample_id, fold, target, source, measured_total, SiO2, unnest([{'c': 'lime', 'v': CaO}, {'c': 'magnesia', 'v': MgO}, {'c': 'potash', 'v': K2O}]) as u from s), l as (select sample_id, fold, target, u.c as c, u.v as v from x)"
_NESTED = f"""{_S}, {_X}, ki as (select a.k, b.i from range(3) a(k), range(3) b(i) where k <> i), fi as (select k, i, c, regr_slope(target, v) as b, regr_intercept(target, v) as a from ki join l on fold <> k and fold <> i group by all),
    ei as (select k, i, c, sqrt(avg((a + b * v - target) ** 2)) as e from fi join l using (c) where fold = i group by all), ch as (select k, arg_min(c, e) as c from (select k, c, avg(e) as e from ei group by all) group by k),
    fo as (select k, c, regr_slope(target, v) as b, regr_intercept(target, v) as a from range(3) r(k) join l on fold <> k group by all), oo as (select l.*, a + b * v as score from l join fo using (c) where fold = k)"""


@query("j01_preprocessor", "oxides", "with m as (select median(SiO2) as a, median(FeOT) as b from oxides) select sample_id, coalesce(SiO2, a) as SiO2, coalesce(FeOT, b) as FeOT from oxides, m")
def j01(oxides):
    """The numbers of the feature vector that the preprocessing stages make: medians in place of missing values."""
    model = Pipeline(stages=ml.preprocessor(["SiO2", "FeOT"], ["source"])).fit(oxides)
    v = ml.vector_to_array("features")
    return model.transform(oxides).select("sample_id", *(F.nanvl(v[i], F.lit(None)).alias(c) for i, c in enumerate(("SiO2", "FeOT"))))


@query("j07_grid_search", "oxides")
def j07(oxides):
    df = _samples(oxides)
    oof = ml.nested_cv(df, "sample_id", "target", ml.candidates("regression", "target", ml.preprocessor(NUMERIC), ["linear"]), 3)
    d.assert_complete(df, oof, "sample_id")
    return m.regression(oof, ["fold", "chosen"], "y", "score").select("fold", "chosen", "n", "rmse", "r2")


@query("j09_learning_curve", "oxides", f"""with {_S}, g as (select source, row_number() over (order by ('0x' || substr(md5('lc|' || source), 1, 8))::bigint, source) as place, count(*) over () as n from (select distinct source from s)),
    t as (select q.f, k.k::int as fold, s.target, s.CaO from (values (0.25e0), (0.5e0), (1e0)) q(f), range(3) k(k), s where s.fold <> k.k and s.source in (select source from g where place <= greatest(3, round(n * q.f)))), r as (select f, fold, count(*) as n_train, regr_slope(target, CaO) as b, regr_intercept(target, CaO) as a from t group by 1, 2)
    select f as fraction, fold, n_train, sqrt(avg((a + b * CaO - target) ** 2)) as rmse from r join s using (fold) group by 1, 2, 3""")
def j09(oxides):
    return ml.learning_curve(_samples(oxides), "sample_id", "target", ml.linear_on(["CaO"], "target"), 3, "source", (0.25, 0.5, 1.0), "lc")


_B = "b as (select quantile_cont(CaO, 0.01) a1, quantile_cont(CaO, 0.99) z1, quantile_cont(SiO2, 0.01) a2, quantile_cont(SiO2, 0.99) z2, quantile_cont(Rb, 0.01) a3, quantile_cont(Rb, 0.99) z3 from s)"
_SCORED = f"""{_S}, {_B}, fo as (select k, regr_slope(target, CaO) as b, regr_intercept(target, CaO) as a from range(3) r(k) join s on fold <> k group by k), qq as (select quantile_cont(abs(a + b * CaO - target), 0.9) as q from s join fo on fold = k), md as (select regr_slope(target, CaO) as sl, regr_intercept(target, CaO) as ic from s),
    sc as (select sample_id, MgO, ic + sl * CaO as p, q, ((CaO is null or CaO < a1 or CaO > z1)::int + (SiO2 is null or SiO2 < a2 or SiO2 > z2)::int + (Rb is null or Rb < a3 or Rb > z3)::int) / 3e0 as outside from s, b, qq, md)"""


def _scored(oxides):
    df, stages = _samples(oxides), ml.linear_on(["CaO"], "target")
    oof = ml.out_of_fold(df, "sample_id", "target", stages[:1], stages[1], 3, "regression")
    q90 = quantiles(oof, [], F.abs(F.col("score") - F.col("y")), {"q90": 0.9}).first().q90
    features = ["CaO", "SiO2", "Rb"]
    return ml.batch_score(Pipeline(stages=stages).fit(df), df, "sample_id", q90, a.profile(df, features), features)


@query("j12_batch_score", "oxides", f"with {_SCORED} select sample_id, case when outside <= 0.5e0 then p end as prediction, case when outside <= 0.5e0 then p - q end as low_q90, case when outside <= 0.5e0 then p + q end as high_q90, outside, case when outside <= 0.5e0 then 'scored' else 'abstained' end as status from sc")
def j12(oxides):
    return _scored(oxides)


@query("j13_integrated_scoring", "oxides", f"""with {_SCORED}, y as (select p as a, MgO as b from sc where outside <= 0.5e0), g as (select count(*) as n, corr(a, b) as r, count(*) filter (a >= 16e0 and b >= 2e0) as both_high, count(*) filter (a >= 16e0 and b < 2e0) as first_high_only, count(*) filter (a < 16e0 and b >= 2e0) as second_high_only, count(*) filter (a < 16e0 and b < 2e0) as both_low from y)
    select *, case when abs(r) < 0.2 then 'very_weak' when abs(r) < 0.4 then 'weak' when abs(r) < 0.6 then 'moderate' when abs(r) < 0.8 then 'strong' else 'very_strong' end as strength from g""")
def j13(oxides):
    first = _scored(oxides).select("sample_id", F.col("prediction").alias("score"))
    return ml.integrated(first, oxides.select("sample_id", F.col("MgO").alias("score")), "sample_id", 16.0, 2.0)


@query("j14_volume_comparison", "oxides", f"""with {_S}, w as (select * replace ((sample_id // 7 % 3)::int as fold), coalesce(measured_total between 94 and 102, false) as va, coalesce(coalesce(measured_total, SiO2 + TiO2 + Al2O3 + Fe2O3 + MnO + MgO + CaO + Na2O + K2O + P2O5) between 94 and 102, false) as vb from s), v as (select 'A' as variant, * from w where va union all select 'B', * from w where vb union all select 'all', * from w),
    r as (select variant, k::int as fold, count(*) as n_train, regr_slope(target, CaO) as b, regr_intercept(target, CaO) as a from range(3) k(k) join v on v.fold <> k group by 1, 2) select variant, fold, n_train, count(*) as n_test, avg(abs(a + b * CaO - target)) as mae from r join w using (fold) where va group by 1, 2, 3""")
def j14(oxides):
    masked = a.protocol_masks(_samples(oxides).withColumn("fold", (F.floor(F.col("sample_id") / 7) % 3).cast("int")))
    return ml.volume_comparison(masked, "sample_id", "target", {"A": F.col("A_original"), "B": F.col("B_reconstructed"), "all": F.lit(True)}, ml.linear_on(["CaO"], "target"), 3)
