"""Queries of model validation by spatial folds and of paired comparisons. Least squares of one number is SQL, too."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import calibration
from veinwork.operators import evidence as e
from veinwork.operators import folds as f
from veinwork.operators import metrics as m
from veinwork.operators import paired as p
from veinwork.operators import preflight as pf
from veinwork.plans import modelling as ml
from veinwork.plans import validation as v
from veinwork.sources.scratch import folder, settled

from .evidence import rank_sql, stored_arms
from .registry import query

FOLDS = 3
ONE = {"lime": "CaO", "magnesia": "MgO", "potash": "K2O"}


def greedy_sql(name: str, keys: str, group: str, source: str, folds: int) -> str:
    """CTEs up to `name`: keys, group, fold, the largest group first, each to the lightest fold so far. keys: an expression as k."""
    places = ", ".join(str(i) for i in range(1, folds + 1))
    least = "list_position(r.load, list_min(r.load))"
    return f"""{name}_s as (select k, {group}, n, row_number() over (partition by k order by n desc, {group}) as i from (select {keys} as k, {group}, count(*) as n from {source} group by 1, 2)),
    {name}_r as (select distinct k, 0::bigint as i, ''::varchar as {group}, {[0] * folds}::bigint[] as load, -1 as fold from {name}_s union all
    select s.k, s.i, s.{group}, [case when x = {least} then r.load[x] + s.n else r.load[x] end for x in [{places}]]::bigint[], ({least} - 1)::int from {name}_r r join {name}_s s on s.k = r.k and s.i = r.i + 1),
    {name} as (select k, {group}, fold::int as fold from {name}_r where i > 0)"""


_CELL = "'g_' || floor((lat + 90) / 2e0)::bigint || '_' || floor((lon + 180) / 2e0)::bigint"
_S = f"s as (select *, {_CELL} as cell, CaO * 2 + MgO + coalesce(SiO2, 40e0) / 10 as target from oxides), {greedy_sql('g', '0', 'cell', 's', FOLDS)}, f as (select s.*, g.fold from s join g using (cell))"
_U = "unnest([{'c': 'lime', 'v': CaO}, {'c': 'magnesia', 'v': MgO}, {'c': 'potash', 'v': K2O}])"


def samples(oxides):
    """Samples with their spatial cell and its fold, written once."""
    s = oxides.withColumn("cell", c.cell("lat", "lon", 2.0)).withColumn("target", F.col("CaO") * 2 + F.col("MgO") + F.coalesce("SiO2", F.lit(40.0)) / 10)
    return settled(s.join(f.group_folds(s, "cell", FOLDS), "cell"), "samples")


def _one(label: str) -> dict[str, list]:
    return {name: ml.linear_on([column], label) for name, column in ONE.items()}


_T = f"""{_S}, th as (select r.k::int as k, quantile_cont(target, 0.75) as t from range({FOLDS}) r(k) join f on f.fold <> r.k group by r.k),
    l as (select sample_id, k, fold, fold = k as held, FeOT is not null as eligible, (target >= t)::int as y, u.c as c, u.v as v from (select f.*, th.k, th.t, {_U} as u from f, th)),
    md as (select k, c, regr_slope(y, v) as b, regr_intercept(y, v) as a from l where not held and eligible group by 1, 2)"""


@query("n17_overfit_audit", "oxides", f"""with {_T}, sc as (select c || '|' || k || case when held then '|test' else '|train' end as id, c, k, held, y, a + b * v as score from l join md using (k, c) where held or eligible), {rank_sql('rk', 'id', 'score', 'sc')},
    b as (select id, any_value(c) as algorithm, any_value(k) as fold, bool_or(held) as held, count(*) as n, avg((score - y) ** 2) as brier from sc group by id), w as (select algorithm, fold, {', '.join(f"max({x}) filter ({'not ' * (p == 'train')}held) as {p}_{x}" for x in ('n', 'auc', 'ap', 'brier') for p in ('train', 'test'))} from b join rk using (id) group by 1, 2)
    select *, train_auc - test_auc as auc_gap, train_ap - test_ap as ap_gap, train_auc - test_auc > 0.15e0 as strong_overfit, 0e0 as refit_difference from w""")
def n17(oxides):
    """Each fold's model scores the rows it was fitted on and those of its fold; saved models say the same again."""
    return v.overfit_audit(samples(oxides), "sample_id", "target", _one("label"), FOLDS, eligible=F.col("FeOT").isNotNull())


@query("e49_generalisation_gap", "oxides", f"""with {_T}, fx as (select quantile_cont(target, 0.75) as t from f), fl as (select sample_id, (target >= t)::int as y, u.c as c, u.v as v from (select f.*, t, {_U} as u from f, fx where FeOT is not null)), fm as (select c, regr_slope(y, v) as b, regr_intercept(y, v) as a from fl group by 1),
    ho as (select l.sample_id, l.c, l.y, a + b * v as score from l join md using (k, c) where held and eligible), sc as (select 'fit|' || c as id, c, y, a + b * v as score from fl join fm using (c) union all select 'hold|' || fl.c, fl.c, fl.y, ho.score from fl join ho using (sample_id, c) union all select 'fold|' || c, c, y, score from ho), {rank_sql('rk', 'id', 'score', 'sc')},
    b as (select id, any_value(c) as algorithm, count(*) as n, sum(y) as pos, avg((score - y) ** 2) as brier, (count(*) filter (score >= 0.5e0 and y = 1) / sum(y) + count(*) filter (score < 0.5e0 and y = 0) / (count(*) - sum(y))) / 2 as balanced_accuracy from sc group by id), w as (select algorithm, max(n) as n, max(pos) filter (id like 'fit%') as positives, {', '.join(f"max({x}) filter (id like '{k}|%') as {k}_{x}" for k in ('fit', 'hold', 'fold') for x in ('auc', 'ap', 'brier', 'balanced_accuracy'))} from b join rk using (id) group by 1)
    select *, fit_auc - hold_auc as auc_gap, fit_ap - hold_ap as ap_gap, fit_auc - hold_auc > 0.15e0 as strong_overfit, fit_auc <= 0.6e0 and hold_auc <= 0.6e0 as underfit from w""")
def e49(oxides):
    return v.generalisation(samples(oxides), "sample_id", "target", _one("label"), FOLDS, eligible=F.col("FeOT").isNotNull())


_N = f"""{_S}, o as (select r.k::int as k, f.* from range({FOLDS}) r(k) join f on f.fold <> r.k), {greedy_sql('h', 'k', 'cell', 'o', 3)}, x as (select o.k, h.fold as i, u.c as c, u.v as v, target from (select *, {_U} as u from o) o join h on h.k = o.k and h.cell = o.cell),
    fi as (select k, i.i, c, regr_slope(target, v) as b, regr_intercept(target, v) as a from range(3) i(i) join x on x.i <> i.i group by all), ei as (select k, i, c, sqrt(avg((a + b * v - target) ** 2)) as e from fi join x using (k, i, c) group by all), ch as (select k, arg_min(c, e) as c from (select k, c, avg(e) as e from ei group by all) group by k),
    fo as (select k, c, regr_slope(target, v) as b, regr_intercept(target, v) as a from x group by all), oo as (select fold, u.c as c, target, a + b * u.v as score from (select *, {_U} as u from f) z join fo on fo.k = z.fold and fo.c = z.u.c)"""


@query("j05_nested_cv", "oxides", f"""with {_N}, no as (select count(*) filter (n > 1) as shared_outer, count(*) as groups from (select cell, count(distinct fold) as n from f group by cell)), ni as (select count(*) filter (n > 1) as shared_inner from (select k, cell, count(distinct fold) as n from h group by all))
    select fold, c as chosen, count(*) as n, sqrt(avg((score - target) ** 2)) as rmse, groups, shared_outer, shared_inner from oo join ch on ch.k = oo.fold and ch.c = oo.c, no, ni group by all""".replace("select fold, c as chosen", "select fold, oo.c as chosen"))
def j05(oxides):
    """Outer folds of whole cells; each one's training cells dealt anew for the choice; the chosen models saved and read back."""
    data = samples(oxides)
    oof = v.nested_cv(data, "sample_id", "target", _one("target"), FOLDS, "cell", 3, save=folder(oxides.sparkSession, "nested"))
    g = oof.groupBy("fold", "chosen").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("score") - F.col("y")) ** 2)).alias("rmse"))
    return g.join(F.broadcast(v.isolation(data, "cell", FOLDS, 3)), how="inner")


@query("j06_gated_competition", "oxides", f"""with {_N}, bl as (select sqrt(avg((m - target) ** 2)) as base from f join (select k, avg(target) as m from o group by 1) on fold = k), q as (select c as algorithm, sqrt(avg((score - target) ** 2)) as rmse from oo group by 1), p as (select algorithm, rmse, 1 - rmse / base as gain, row_number() over (order by rmse, algorithm)::int as place from q, bl),
    al as (select u.c as algorithm, u.v as v, target from (select target, {_U} as u from f)), am as (select algorithm, regr_slope(target, v) as b, regr_intercept(target, v) as a from al group by 1), ar as (select algorithm, sqrt(avg((a + b * v - target) ** 2)) as final_rmse from al join am using (algorithm) group by 1)
    select p.*, place = 1 and gain >= 0.05e0 as passes, case when place = 1 and gain >= 0.05e0 then final_rmse end as final_rmse from p join ar using (algorithm)""")
def j06(oxides):
    return v.competition(samples(oxides), "sample_id", "target", {name: {name: stages} for name, stages in _one("target").items()}, FOLDS, "cell")


REPS = 40
_PAIRED = "pr as (select cell, fold, cohort, y, coarse as reference, fine as candidate from oof)"


def bootstrap_sql(name: str, source: str, key: str, replicates: int, seed: str, group: str = "cell") -> str:
    """CTEs up to `name`: the rows of paired.bootstrap() by one key, of a source with group, y, reference and candidate."""
    above = f"over (partition by {key}, rep, side order by s desc rows between unbounded preceding and 1 preceding)"
    n = name
    return f"""{n}_g as (select {key}, {group}, row_number() over (partition by {key} order by {group}) - 1 as i, count(*) over (partition by {key}) as g from (select distinct {key}, {group} from {source})),
    {n}_w as (select {key}, rep, i, count(*) as w from (select {key}, rep, ('0x' || substr(md5('{seed}|' || rep || '|' || i), 1, 8))::bigint % g as i from {n}_g, range({replicates}) t(rep)) group by all),
    {n}_a as (select {key}, {group}, y, unnest([{{'side': 'reference', 's': reference}}, {{'side': 'candidate', 's': candidate}}]) as u from {source}),
    {n}_c as (select {key}, -1 as rep, u.side as side, u.s as s, y, count(*)::double as w from {n}_a group by all union all select a.{key}, rep, u.side, u.s, y, sum(w)::double from {n}_a a join {n}_g g on g.{key} = a.{key} and g.{group} = a.{group} join {n}_w w on w.{key} = g.{key} and w.i = g.i group by all),
    {n}_d as (select {key}, rep, side, s, sum(w * y) as p, sum(w * (1 - y)) as q, sum(w * (s - y) * (s - y)) as e from {n}_c group by all), {n}_z as (select *, coalesce(sum(p) {above}, 0) as pa, coalesce(sum(q) {above}, 0) as qa from {n}_d),
    {n}_m as (select {key}, rep, side, sum(q * (pa + p / 2)) / (sum(p) * sum(q)) as auc, sum(case when p > 0 then p * (pa + p) / (pa + p + qa + q) else 0 end) / sum(p) as ap, sum(e) / sum(p + q) as brier, sum(p) > 0 and sum(q) > 0 as two from {n}_z group by all),
    {n}_l as (select {key}, rep, side, two, unnest([{{'metric': 'auc', 'v': auc}}, {{'metric': 'ap', 'v': ap}}, {{'metric': 'brier', 'v': brier}}]) as u from {n}_m),
    {n}_p as (select {key}, rep, u.metric as metric, max(u.v) filter (side = 'reference' and two) as reference, max(u.v) filter (side = 'candidate' and two) as candidate from {n}_l group by all),
    {n}_i as (select {key}, metric, count(candidate - reference) as draws, quantile_cont(candidate - reference, 0.025) as low, quantile_cont(candidate - reference, 0.975) as high from {n}_p where rep >= 0 group by all),
    {n}_n as (select {key}, count(*) as n, count(distinct {group}) as groups from {source} group by all),
    {n}_t as (select *, case when groups < 5 then 'too_few_groups' when draws < {max(20, replicates // 2)} then 'too_few_draws' else 'ok' end as status from {n}_p join {n}_i using ({key}, metric) join {n}_n using ({key}) where rep = -1),
    {n} as (select {key}, metric, reference, candidate, candidate - reference as delta, n, groups, draws, case when status = 'ok' then low end as low, case when status = 'ok' then high end as high, case when status = 'ok' then low <= 0 and high >= 0 end as includes_zero, status from {n}_t)"""


def _pairs(oof):
    arm = lambda s: oof.select("sample_id", "cell", "fold", "cohort", "y", F.col(s).alias("score"))
    return settled(p.pairs(arm("coarse"), arm("fine").select("sample_id", "y", "score"), "sample_id"), "pairs")


@query("g08_paired_bootstrap", "oof", f"with {_PAIRED}, {bootstrap_sql('b', 'pr', 'cohort', REPS, 'pb')} select * from b")
def g08_paired(oof):
    """Intervals of what AUC, AP and Brier score change from one arm to the other, by cohort, under resampling of whole cells."""
    return p.bootstrap(_pairs(oof), ["cohort"], "cell", REPS)


_STRATA = "'all' as stratum union all select *, 'cohort ' || cohort from pr union all select *, 'fold ' || fold from pr"


@query("k15_paired_diagnostic", "oof", f"""with {_PAIRED}, st as (select *, {_STRATA}), {bootstrap_sql('b', 'st', 'stratum', REPS, 'k15')}, h as (select stratum, {', '.join(f"count(*) filter ({a} >= 0.5e0 and y = 1) / greatest(sum(y), 1) as {a}_recall, count(*) filter ({a} < 0.5e0 and y = 0) / greatest(count(*) - sum(y), 1) as {a}_specificity" for a in ('reference', 'candidate'))},
    count(*) filter ((candidate >= 0.5e0)::int = y and (reference >= 0.5e0)::int <> y) as only_candidate, count(*) filter ((candidate >= 0.5e0)::int <> y and (reference >= 0.5e0)::int = y) as only_reference from st group by 1),
    rb as (select stratum, {', '.join(f"sum(abs(r{a} - m{a}) * n{a}) / sum(n{a}) as {a}_ece" for a in ('reference', 'candidate'))} from (select stratum, bin, {', '.join(f"count(*) filter (arm = '{a}') as n{a}, coalesce(avg(s) filter (arm = '{a}'), 0) as m{a}, coalesce(avg(y) filter (arm = '{a}'), 0) as r{a}" for a in ('reference', 'candidate'))} from (select stratum, y, u.arm as arm, u.s as s, least(floor(u.s * 10), 9) as bin from (select stratum, y, unnest([{{'arm': 'reference', 's': reference}}, {{'arm': 'candidate', 's': candidate}}]) as u from st)) group by all) group by 1)
    select b.*, h.* exclude (stratum), rb.* exclude (stratum) from b join h using (stratum) join rb using (stratum)""".replace(_STRATA, f"{_STRATA.replace(' union', ' from pr union', 1)}"))
def k15(oof):
    """All rows, each cohort and each fold: both arms' metrics with intervals of their deltas, hits and calibration, and the rows that one arm alone has right."""
    rows = _pairs(oof)
    strata = F.array(F.lit("all"), F.concat(F.lit("cohort "), "cohort"), F.concat(F.lit("fold "), F.col("fold").cast("string")))
    st = settled(rows.select("*", F.explode(strata).alias("stratum")), "strata")
    out = p.bootstrap(st, ["stratum"], "cell", REPS, "k15")
    for arm in ("reference", "candidate"):
        hits = m.confusion(st, ["stratum"], 0.5, "y", arm).select("stratum", F.col("recall").alias(f"{arm}_recall"), F.col("specificity").alias(f"{arm}_specificity"))
        ece = m.calibration_error(st, ["stratum"], 10, "y", arm).withColumnRenamed("ece", f"{arm}_ece")
        out = out.join(hits, "stratum").join(ece, "stratum")
    hit = lambda s: (F.col(s) >= 0.5).cast("int") == F.col("y")
    only = st.groupBy("stratum").agg(F.count_if(hit("candidate") & ~hit("reference")).alias("only_candidate"), F.count_if(~hit("candidate") & hit("reference")).alias("only_reference"))
    return out.join(only, "stratum")


_CLOSE = """cr as (select sample_id, cell, fold, y, coarse from oof where cohort <> 'view'), rt as (select k.f as fold, coarse, avg(y) as rate from range(5) k(f) join cr on cr.fold <> k.f group by 1, 2), pv as (select k.f as fold, avg(y) as rate from range(5) k(f) join cr on cr.fold <> k.f group by 1),
    oo as (select sample_id, cell, fold, y, coarse as archived, fine as corrected from oof where cohort <> 'view'), oc as (select oo.*, coalesce(rt.rate, pv.rate) as calibrated from oo left join rt on rt.fold = oo.fold and rt.coarse = oo.archived join pv on pv.fold = oo.fold),
    ca as (select 'corrected' as arm, cell, y, archived as reference, corrected as candidate from oc union all select 'calibrated', cell, y, archived, calibrated from oc)"""


@query("n12_release_closure", "oof", f"with {_CLOSE}, {bootstrap_sql('b', 'ca', 'arm', REPS, 'n12')} select * from b")
def n12(oof):
    """A release's archived scores against the corrected ones and against its own calibrated on other folds, on the rows all stored runs have."""
    stored = stored_arms(oof).join(oof.select("sample_id", "cell"), "sample_id")
    arm = lambda a: stored.where(F.col("arm") == a).select("sample_id", "cell", "fold", "y", "score")
    archived = settled(arm("coarse"), "archived")
    calibrated = settled(e.rate_calibrated(archived, 5), "calibrated")
    out = None
    for name, candidate in (("corrected", arm("fine")), ("calibrated", calibrated)):
        rows = p.pairs(archived, candidate, "sample_id").withColumn("arm", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return p.bootstrap(out, ["arm"], "cell", REPS, "n12")


def newton_sql(name: str, key: str, source: str, steps: int = calibration.STEPS) -> str:
    """CTEs up to `name`: key, slope, intercept, converged, of a source with key, score and y; each step is a CTE of its own."""
    n = name
    out = f"""{n}_c as materialized (select {key}, score, sum(y)::double as pos, (count(*) - sum(y))::double as neg from {source} group by all), {n}_t as (select {key}, (sum(pos) + 1) / (sum(pos) + 2) as high, 1 / (sum(neg) + 2) as low, ln((sum(pos) + 1) / (sum(neg) + 1)) as intercept, 0e0 as slope from {n}_c group by all having sum(pos) > 0 and sum(neg) > 0 and count(distinct score) > 1), {n}_0 as (select *, null::double as moved from {n}_t)"""
    for i in range(steps):
        out += f""", {n}_s{i} as materialized (select {key}, high, low, slope, intercept, sum(o) as g0, sum(o * score) as g1, sum(w) as h0, sum(w * score) as h1, sum(w * score * score) as h2 from (select *, pos * high + neg * low - (pos + neg) * p as o, (pos + neg) * p * (1 - p) as w from (select *, 1 / (1 + exp(-(slope * score + intercept))) as p from {n}_c join {n}_{i} using ({key}))) group by all),
        {n}_{i + 1} as materialized (select {key}, high, low, slope + a as slope, intercept + b as intercept, abs(a) + abs(b) as moved from (select *, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as a, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as b from {n}_s{i}))"""
    return f"{out}, {name} as (select {key}, slope, intercept, moved < 1e-6 as converged from {n}_{steps})"


@query("j08_calibration", "oof", f"with l as (select k.f::int as fold, fine as score, y from range(5) k(f) join oof on oof.fold <> k.f), {newton_sql('c', 'fold', 'l')}, a as (select o.fold, y, slope, intercept, converged, fine, 1 / (1 + exp(-(slope * fine + intercept))) as s from oof o join c using (fold)), b as (select fold, least(floor(s * 10), 9) as bin, count(*) as n, abs(avg(y) - avg(s)) as gap from a group by all), e as (select fold, sum(n * gap) / sum(n) as ece from b group by 1) select fold, slope, intercept, converged, count(*) as n, avg((fine - y) ** 2) as raw_brier, avg((s - y) ** 2) as brier, any_value(ece) as ece from a join e using (fold) group by all")
def j08(oof):
    """Each fold's scores through a sigmoid fitted on the out-of-fold scores of the others."""
    others = f.training_rows(calibration.score_counts(oof, ["fold"], "y", "fine"), 5).groupBy(F.col("train_fold").alias("fold"), "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    fits = calibration.fit(others, ["fold"])
    said = settled(oof.join(F.broadcast(fits), "fold").withColumn("s", calibration.applied(F.col("fine"), F.col("slope"), F.col("intercept"))), "calibrated")
    sq = lambda c: F.avg((F.col(c) - F.col("y")) ** 2)
    g = said.groupBy("fold", "slope", "intercept", "converged").agg(F.count(F.lit(1)).alias("n"), sq("fine").alias("raw_brier"), sq("s").alias("brier"))
    return g.join(m.calibration_error(said, ["fold"], score="s"), "fold")


_N18 = f"""{_T}, lo as (select k as fold, sample_id, y, a + b * v as score from l join (select k, c, regr_slope(y, v) as b, regr_intercept(y, v) as a from l where not held group by 1, 2) using (k, c) where held and c = 'lime'),
    o as (select r.k::int as k, f.* from range({FOLDS}) r(k) join f on f.fold <> r.k), {greedy_sql('h', 'k', 'cell', 'o', 3)}, x as (select o.k, h.fold as i, CaO as v, (target >= t)::int as y from o join th on th.k = o.k join h on h.k = o.k and h.cell = o.cell),
    xm as (select k, i.i, regr_slope(y, v) as b, regr_intercept(y, v) as a from range(3) i(i) join x on x.i <> i.i group by all), ws as (select k as fold, y, a + b * v as score from x join xm using (k, i)), {newton_sql('c', 'fold', 'ws')},
    wc as (select ws.fold, y, 1 / (1 + exp(-(slope * score + intercept))) as s from ws join c using (fold)), d as (select fold, s, sum(y) as p, count(*) - sum(y) as q from wc group by all), nx as (select fold, s, lead(s) over (partition by fold order by s) as nx from d), tt as (select distinct fold, t from (select fold, s as t from nx union all select fold, (s + nx) / 2 from nx where nx is not null union all select fold, unnest([0e0, 0.5e0, 1e0]) from c)),
    tm as (select tt.fold, t, sum(case when s >= t then p else 0 end) as tp, sum(case when s >= t then q else 0 end) as fp, sum(p) as p, sum(q) as q from tt join d using (fold) group by 1, 2), tk as (select fold, t, row_number() over (partition by fold order by round((tp / p + 1 - fp / q) / 2, 12) desc, round(2 * tp / (p + tp + fp), 12) desc, round(tp / p, 12) desc, round(abs(t - 0.5e0), 12), t) as place from tm), fz as (select fold, t as threshold from tk where place = 1),
    hc as (select lo.fold, lo.y, lo.score as r, 1 / (1 + exp(-(slope * score + intercept))) as s, threshold from lo join c using (fold) join fz using (fold))"""


def _ba(hit: str) -> str:
    return f"((count(*) filter ({hit} and y = 1)) / greatest(sum(y), 1) + (count(*) filter (not ({hit}) and y = 0)) / greatest(count(*) - sum(y), 1)) / 2"


@query("n18_nested_calibration", "oxides", f"with {_N18}, r as (select fold, count(*) as n, any_value(threshold) as threshold, avg((r - y) ** 2) as raw_brier, {_ba('r >= 0.5e0')} as raw_balanced_accuracy, avg((s - y) ** 2) as calibrated_brier, {_ba('s >= 0.5e0')} as calibrated_balanced_accuracy, {_ba('s >= threshold')} as frozen_balanced_accuracy from hc group by 1) select r.*, slope, intercept, converged from r join c using (fold)")
def n18(oxides):
    """Calibrator and threshold of each outer fold from inner scores of its training cells, frozen, then applied to the fold."""
    return v.nested_calibration(samples(oxides), "sample_id", "target", _one("label")["lime"], FOLDS, "cell")


#: A table with a fault for each check: a copied target, an identifier, a name and a content given twice, an empty and a constant column, targets that aren't
#: finite, places that aren't ones, rows given twice. One check each finds nothing of these.
_FAULTY = """fb as (select sample_id as key, SiO2, CaO, MgO, K2O, Rb, Sr, CaO as lime, MgO as "cao ", null::double as blank, li as assay, sample_id as "Sample_ID ", case when sample_id % 40 = 0 then 'nan'::double else li end as target, case when sample_id % 90 = 7 then 95e0 when sample_id % 90 = 8 then null else lat end as lat, lon, 'g_' || floor(coalesce(lat, 0) / 20)::int as cell from oxides), fy as (select * from fb union all select * from fb where key % 50 = 3)"""
_PREDICTORS = ["SiO2", "CaO", "MgO", "K2O", "Rb", "Sr", "lime", "cao ", "blank", "assay", "Sample_ID "]


def faulty(oxides):
    nan = F.when(F.col("sample_id") % 40 == 0, F.lit(float("nan"))).otherwise(F.col("li"))
    lat = F.when(F.col("sample_id") % 90 == 7, F.lit(95.0)).when(F.col("sample_id") % 90 != 8, F.col("lat"))
    cell = F.concat(F.lit("g_"), F.floor(F.coalesce("lat", F.lit(0.0)) / 20).cast("string"))
    df = oxides.select(F.col("sample_id").alias("key"), "SiO2", "CaO", "MgO", "K2O", "Rb", "Sr", F.col("CaO").alias("lime"), F.col("MgO").alias("cao "), F.lit(None).cast("double").alias("blank"), F.col("li").alias("assay"), F.col("sample_id").alias("Sample_ID "), nan.alias("target"), lat.alias("lat"), "lon", cell.alias("cell"))
    return df.unionByName(df.where("key % 50 = 3"))


_FULL = ", ".join(f'"{c}"' for c in [*_PREDICTORS, "target"])


@query("k03_preflight", "oxides", f"""with {_FAULTY}, fn as (select *, not isnan(target) and target is not null as okay, coalesce(lat between -90 and 90 and lon between -180 and 180, false) as place from fy), cl as (select {', '.join(f'count("{c}") as "n_{c}", count(distinct "{c}") as "d_{c}", count(*) filter (okay and "{c}" = target) as "e_{c}", count("{c}") filter (okay) as "b_{c}"' for c in _PREDICTORS)} from fn)
    select 'leaking' as "check", 'error' as severity, (case when "e_assay" = "b_assay" then 1 else 0 end)::bigint as n, case when "e_assay" = "b_assay" then 'assay' else '' end as names from cl union all select 'identifiers', 'error', 1, 'Sample_ID ' union all select 'repeated_names', 'error', 1, 'cao ' union all select 'repeated_content', 'warning', (select count(*) from (select bool_and(CaO is not distinct from lime) as a from fy) where a) + (select count(*) from (select bool_and(MgO is not distinct from "cao ") as a from fy) where a), 'lime,cao ' union all select 'all_missing', 'error', ("n_blank" = 0)::bigint, 'blank' from cl union all select 'constant', 'warning', ("d_Sr" = 1)::bigint, 'Sr' from cl
    union all select 'target_not_finite', 'error', count(*) filter (not okay), '' from fn union all select 'coordinates', 'error', count(*) filter (not place), '' from fn union all select 'groups', 'error', greatest(0, 3 - count(distinct cell)), '' from fn where place union all select 'repeated_rows', 'warning', (select count(*) from fy) - (select count(*) from (select distinct {_FULL} from fy)), '' union all select 'repeated_places', 'warning', count(*) - count(distinct lat::varchar || '|' || lon::varchar), '' from fy where lat is not null and lon is not null""")
def k03(oxides):
    """All checks on a table that has a fault for each of them."""
    return pf.preflight(settled(faulty(oxides), "faulty"), "key", "target", _PREDICTORS, "lat", "lon", "cell", FOLDS)


_G14 = "md5('g14|' || sample_id)"


@query("g14_noise_stress", "oxides", f"""with {_S}, fo as (select r.k::int as k, regr_slope(target, CaO) as b, regr_intercept(target, CaO) as a, stddev_pop(CaO) as s from range({FOLDS}) r(k) join f on f.fold <> r.k group by r.k), z as (select f.fold, target, CaO, a, b, s, sqrt(-2 * ln((('0x' || substr({_G14}, 1, 8))::bigint + 0.5e0) / 4294967296e0)) * cos(('0x' || substr({_G14}, 9, 8))::bigint * (2 * pi() / 4294967296e0)) as z from f join fo on fo.k = f.fold)
    select fold, share, count(*) as n, avg(abs(a + b * CaO - target)) as mae, avg(abs(a + b * (CaO + z * s * share) - target)) as noisy_mae, avg(abs(a + b * (CaO + z * s * share) - target)) - avg(abs(a + b * CaO - target)) as shift from z, (values (0.01e0), (0.05e0), (0.1e0), (0.25e0)) q(share) group by 1, 2""")
def g14(oxides):
    """How far each fold's error moves when its rows' feature carries noise."""
    return v.noise_stress(samples(oxides), "sample_id", "target", "CaO", ml.linear_on(["CaO"], "target"), FOLDS, (0.01, 0.05, 0.1, 0.25))


_MANIFEST = """mf as (select case when id % 97 = 0 then ' ' when id % 89 = 0 then ' S1 ' else 'S' || id end as sample, case when id % 71 = 0 then null else path end as path, 'g_' || (id % 9) as grp, case when id % 61 = 0 then null when id % 67 = 0 then 95e0 else floor(lat / 5) * 5 end as lat,
    case when id % 59 = 0 then 'inf'::double else floor(lon / 5) * 5 end as lon, case when id % 53 = 0 then -1e0 else coalesce(li, 21.6e0) end as li, verification, dataset from raw join oxides on oxides.sample_id = raw.id)"""


@query("k07_sample_contract", "raw oxides", f"""with {_MANIFEST}, w as (select *, case when trim(sample) <> '' then trim(sample) end as tid, coalesce(isfinite(lat) and isfinite(lon) and isfinite(li), false) as whole from mf), n as (select tid from w where tid is not null group by 1 having count(*) > 1),
    q as (select sample, case when whole then printf('%.5f', lat) || '|' || printf('%.5f', lon) end as site, substr(sha256(lower(replace(path, chr(92), '/'))), 1, 20) as patch, case when upper(verification) in ('FIELD_VERIFIED_SURFACE', 'GPS_AND_SURFACE_VERIFIED') then 'verified' when regexp_matches(upper(verification), 'EXCLUDE|SUBSURFACE|DRILL_CORE|INVALID') then 'excluded' when upper(verification) in ('PRE_SCREENED_NOT_FIELD_VERIFIED', 'PROVISIONAL_SITE_REVIEW') then 'provisional' when dataset like 'GEOROC_B_SURFACE_PROVISIONAL%' then 'provisional' else 'historical' end as status,
    case when whole and li >= 21.6e0 then 'high' when whole then 'low' end as label, array_to_string(list_filter([case when tid is null then 'no_id' end, case when tid in (select tid from n) then 'repeated_id' end, case when coalesce(trim(path), '') = '' then 'no_path' end, case when not whole then 'not_finite' end, case when whole and (abs(lat) > 90 or abs(lon) > 180) then 'out_of_range' end, case when whole and li < 0 then 'negative' end], lambda z: z is not null), ',') as problems from w),
    m as (select site, min(label) <> max(label) as mixed from q where problems = '' group by 1) select q.sample, q.site, patch, status, label, case when problems = '' and mixed then 'mixed' when problems = '' then 'one_label' end as site_labels, problems from q left join m on m.site = q.site""")
def k07(raw, oxides):
    """A manifest with every fault: sites, patches, eligibility and labels of its rows, sites of both labels, and what is wrong with a row."""
    k = F.col("id")
    m = raw.join(oxides.select(F.col("sample_id").alias("id"), "lat", "lon", "li"), "id").select(
        F.when(k % 97 == 0, " ").when(k % 89 == 0, " S1 ").otherwise(F.concat(F.lit("S"), k.cast("string"))).alias("sample_id"), F.when(k % 71 != 0, F.col("path")).alias("image_path"), F.concat(F.lit("g_"), (k % 9).cast("string")).alias("spatial_group"),
        F.when(k % 61 == 0, F.lit(None)).when(k % 67 == 0, F.lit(95.0)).otherwise(F.floor(F.col("lat") / 5) * 5.0).alias("lat"), F.when(k % 59 == 0, F.lit(float("inf"))).otherwise(F.floor(F.col("lon") / 5) * 5.0).alias("lon"),
        F.when(k % 53 == 0, F.lit(-1.0)).otherwise(F.coalesce("li", F.lit(21.6))).alias("li"), "verification", "dataset")
    return pf.contract(m, "sample_id", "image_path", "spatial_group", "lat", "lon", "li", "verification", "dataset", 21.6)
