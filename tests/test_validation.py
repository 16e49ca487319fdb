"""Nested folds, saved models, paired intervals and the upserting stream on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from veinwork.operators import folds, paired
from veinwork.plans import modelling, validation
from veinwork.streaming import ingest


def greedy(sizes, k):
    load, out = [0] * k, {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        i = load.index(min(load))
        out[group] = i
        load[i] += n
    return out


def test_inner_folds_are_dealt_among_training_groups(spark):
    r = random.Random(1)
    groups = {f"g{i}": (r.randint(1, 9), i % 3) for i in range(25)}
    df = spark.createDataFrame([(g, k) for g, (n, k) in groups.items() for _ in range(n)], "cell string, fold int").repartition(5)
    got = {(x.outer, x.cell): x.inner for x in folds.nested_folds(df, "cell", 3, 4).collect()}
    want = {(k, g): i for k in range(3) for g, i in greedy({g: n for g, (n, f) in groups.items() if f != k}, 4).items()}
    assert got == want
    assert folds.nested_folds(df.where("1 = 0"), "cell", 3, 2).count() == 0


def frame(spark, n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, f"c{i % 24}", (i % 24) % 3, x, z, 2 * x + 0.1 * r.gauss(0, 1), i % 5 != 0))
    return spark.createDataFrame(rows, "id bigint, cell string, fold int, x double, z double, target double, good boolean").repartition(4)


def test_models_score_their_own_training_rows_and_their_fold(spark):
    df = frame(spark)
    got = validation.overfit_audit(df, "id", "target", {"x": modelling.linear_on(["x"], "label"), "z": modelling.linear_on(["z"], "label")}, 3, eligible=F.col("good")).collect()
    assert len(got) == 6 and all(r.refit_difference == 0 and r.test_n == 80 and r.train_n == 128 for r in got)
    assert all(r.train_auc > 0.95 and r.test_auc > 0.95 for r in got if r.algorithm == "x") and all(r.test_auc < 0.75 for r in got if r.algorithm == "z")


def test_nested_choice_and_saved_models(spark, tmp_path):
    df = frame(spark)
    choices = {"a_z": modelling.linear_on(["z"], "target"), "b_x": modelling.linear_on(["x"], "target")}
    oof = validation.nested_cv(df, "id", "target", choices, 3, "cell", save=str(tmp_path / "m")).collect()
    assert {r.chosen for r in oof} == {"b_x"} and sorted(r.id for r in oof) == list(range(240)) and max(abs(r.score - r.y) for r in oof) < 0.6
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["fold_0", "fold_1", "fold_2"]
    board = {r.algorithm: r for r in validation.competition(df, "id", "target", {"x": {"x": choices["b_x"]}, "z": {"z": choices["a_z"]}}, 3, "cell").collect()}
    assert board["x"].passes and board["x"].final_rmse < 0.15 and not board["z"].passes and board["z"].final_rmse is None
    none = validation.competition(df, "id", "target", {"z": {"z": choices["a_z"]}}, 3, "cell").first()
    assert not none.passes and none.final_rmse is None


def arms(spark, rows):
    ref = spark.createDataFrame([(i, g, y, a) for i, g, y, a, _ in rows], "id bigint, cell string, y int, score double")
    return ref, spark.createDataFrame([(i, y, b) for i, _, y, _, b in rows], "id bigint, y int, score double")


def test_paired_intervals(spark):
    r = random.Random(3)
    rows = [(i, f"c{i % 12}", y := int(r.random() < 0.4), round(r.random(), 2), round(0.7 * y + 0.3 * r.random(), 2)) for i in range(300)]
    got = {x.metric: x for x in paired.bootstrap(paired.pairs(*arms(spark, rows), "id"), [], "cell", 60).collect()}
    wins = lambda k: sum((p[k] > q[k]) + (p[k] == q[k]) / 2 for p in rows if p[2] for q in rows if not q[2]) / sum(p[2] for p in rows) / sum(1 - q[2] for q in rows)
    assert got["auc"].reference == pytest.approx(wins(3)) and got["auc"].candidate == pytest.approx(wins(4)) == 1.0
    assert got["brier"].delta == pytest.approx(sum((x[4] - x[2]) ** 2 - (x[3] - x[2]) ** 2 for x in rows) / 300)
    assert all(x.status == "ok" and x.draws == 60 and x.groups == 12 and x.n == 300 and not x.includes_zero and x.low <= x.delta <= x.high for x in got.values())
    same = paired.bootstrap(paired.pairs(*arms(spark, [(*x[:4], x[3]) for x in rows]), "id"), [], "cell", 60).collect()
    assert all(x.delta == 0 and x.low == x.high == 0 and x.includes_zero for x in same)


def test_draws_that_do_not_count(spark):
    few = [(i, f"c{i % 4}", i % 2, 0.5, 0.6) for i in range(40)]
    assert {x.status for x in paired.bootstrap(paired.pairs(*arms(spark, few), "id"), [], "cell", 30).collect()} == {"too_few_groups"}
    one = [(i, f"c{i}", int(i == 0), 0.1 * (i % 7), 0.2) for i in range(30)]  # its only positive is missed by every third draw
    got = paired.bootstrap(paired.pairs(*arms(spark, one), "id"), [], "cell", 60).collect()
    assert all(x.draws < 60 for x in got)
    none = [(i, f"c{i}", 0, 0.1, 0.2) for i in range(30)]
    got = paired.bootstrap(paired.pairs(*arms(spark, none), "id"), [], "cell", 30).collect()
    assert {(x.status, x.draws, x.low, x.reference) for x in got} == {("too_few_draws", 0, None, None)}


@pytest.mark.parametrize("bad", [[(1, "c", 0, 0.5, float("nan"))], [(1, "c", 0, None, 0.5)]])
def test_scores_must_be_finite(spark, bad):
    with pytest.raises(ValueError):
        paired.pairs(*arms(spark, bad), "id")


def test_arms_must_agree(spark):
    ref, cand = arms(spark, [(i, "c", i % 2, 0.5, 0.6) for i in range(6)])
    for wrong in (cand.where("id <> 3"), cand.withColumn("y", F.lit(1)), cand.unionByName(cand)):
        with pytest.raises(ValueError):
            paired.pairs(ref, wrong, "id")
    assert paired.pairs(ref, cand, "id").count() == 6


def test_stream_is_stopped_and_resumed(spark, tmp_path):
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-{n:02d} 12:00:00"))
    schema, src = "k string, v bigint, x string, ts timestamp", str(tmp_path / "in")

    def lot(rows):
        df = None
        for k, v, x, d in rows:
            one = spark.range(1).select(F.lit(k).alias("k"), F.lit(v).cast("bigint").alias("v"), F.lit(x).alias("x"), day(d).alias("ts"))
            df = one if df is None else df.unionByName(one)
        df.coalesce(1).write.mode("append").parquet(src)
        ingest.upserting(spark, src, schema, "ts", ["k"], "v", str(tmp_path / "out"), str(tmp_path / "cp"), "2 days").awaitTermination()
        return {r.k: (r.v, r.x) for r in ingest.upserted(spark, str(tmp_path / "out")).collect()}

    assert lot([("a", 1, "old", 10), ("b", 1, "b1", 12)]) == {"a": (1, "old"), "b": (1, "b1")}
    assert lot([("a", 2, "new", 13), ("c", 1, "c1", 14), ("b", 9, "late", 2)]) == {"a": (2, "new"), "b": (1, "b1"), "c": (1, "c1")}
    assert lot([("c", 1, "again", 14), ("a", 1, "older", 15)]) == {"a": (2, "new"), "b": (1, "b1"), "c": (1, "c1")}
    before = ingest.versions(spark, str(tmp_path / "out"))
    ingest.upserting(spark, src, schema, "ts", ["k"], "v", str(tmp_path / "out"), str(tmp_path / "cp"), "2 days").awaitTermination()
    ingest.upsert(str(tmp_path / "out"), ["k"], "v")(spark.createDataFrame([("a", 99, "x", None)], schema), before[-1][0])
    assert ingest.versions(spark, str(tmp_path / "out"))[: len(before)] == before
    ingest.pruned(spark, str(tmp_path / "out"))
    assert {r.k: r.x for r in ingest.upserted(spark, str(tmp_path / "out")).collect()} == {"a": "new", "b": "b1", "c": "c1"}


def newton(rows, steps=50):
    """Logistic fit of drawn-in targets by plain gradient steps' fixed point: Newton on rows, one by one."""
    import math

    p, q = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    high, low, a, b = (p + 1) / (p + 2), 1 / (q + 2), 0.0, math.log((p + 1) / (q + 1))
    for _ in range(steps):
        g0 = g1 = h0 = h1 = h2 = 0.0
        for s, y in rows:
            m = 1 / (1 + math.exp(-(a * s + b)))
            t, w = (high if y else low), m * (1 - m)
            g0, g1, h0, h1, h2 = g0 + t - m, g1 + (t - m) * s, h0 + w, h1 + w * s, h2 + w * s * s
        det = h0 * h2 - h1 * h1
        a, b = a + (h0 * g1 - h1 * g0) / det, b + (h2 * g0 - h1 * g1) / det
    return a, b


def test_sigmoid_fits(spark):
    from veinwork.operators import calibration

    r = random.Random(5)
    rows = [(k, round(r.random(), 2), int(r.random() < 0.3 + 0.1 * k)) for k in range(3) for _ in range(200)]
    rows += [(3, x / 10, int(x >= 5)) for x in range(10)] + [(4, 0.1 * x, 1) for x in range(5)] + [(5, 0.5, x % 2) for x in range(6)] + [(0, None, 1), (0, 0.5, None)]
    df = spark.createDataFrame(rows, "k int, score double, y int").repartition(3)
    got = {x.k: x for x in calibration.fit(calibration.score_counts(df, ["k"]), ["k"], 30).collect()}
    assert set(got) == {0, 1, 2, 3}  # one class, and one score, have no fit
    for k, x in got.items():
        want = newton([(s, y) for g, s, y in rows if g == k and s is not None and y is not None])
        assert x.converged and (x.slope, x.intercept) == pytest.approx(want, rel=1e-6), k
    one = calibration.fit(calibration.score_counts(df.where("k = 1"), []), []).first()
    assert (one.slope, one.intercept) == pytest.approx((got[1].slope, got[1].intercept))
    assert calibration.fit(calibration.score_counts(df.where("1 = 0"), ["k"]), ["k"]).count() == 0


def test_nested_calibrators_see_training_rows_alone(spark):
    df = frame(spark)
    stages = modelling.linear_on(["x"], "label")
    got = {r.fold: r for r in validation.nested_calibration(df, "id", "target", stages, 3, "cell").collect()}
    # other values of x in fold 0's own rows change neither its calibrator nor its threshold
    changed = df.withColumn("x", F.when(F.col("fold") == 0, -F.col("x")).otherwise(F.col("x")))
    again = {r.fold: r for r in validation.nested_calibration(changed, "id", "target", stages, 3, "cell").collect()}
    assert got[0].slope == pytest.approx(again[0].slope) and got[0].threshold == pytest.approx(again[0].threshold) and got[0].raw_brier != pytest.approx(again[0].raw_brier)
    assert all(r.n == 80 and r.converged and r.calibrated_brier < r.raw_brier for r in got.values())


def test_preflight_finds_what_is_seeded_and_nothing_else(spark):
    from veinwork.operators import preflight

    nan = float("nan")
    rows = [(i, float(i % 7), float(i % 5), -60.0 + i, -20.0 + i / 10, f"c{i % 4}", float(i)) for i in range(30)]
    schema = "key bigint, a double, b double, lon double, lat double, cell string, target double"
    fine = spark.createDataFrame(rows, schema)
    found = lambda df, columns: {r.check: (r.n, r.names) for r in preflight.preflight(df, "key", "target", columns, "lat", "lon", "cell", 4).collect()}
    clean = found(fine, ["a", "b"])
    assert len(clean) == 11 and all(v == (0, "") for v in clean.values())
    preflight.passed(preflight.preflight(fine, "key", "target", ["a", "b"], "lat", "lon", "cell", 4))
    bad = fine.withColumn("copy", F.col("target")).withColumn("B ", F.col("a") * 2).withColumn("Source_Sample", F.lit("x")).withColumn("none", F.lit(None).cast("double")).withColumn("twin", F.col("b"))
    got = found(bad, ["a", "b", "copy", "B ", "Source_Sample", "none", "twin"])
    assert got["leaking"] == (1, "copy") and got["repeated_names"] == (1, "B ") and got["identifiers"] == (1, "Source_Sample") and got["all_missing"] == (1, "none")
    assert got["constant"] == (1, "Source_Sample") and got["repeated_content"] == (1, "twin")
    odd = spark.createDataFrame(rows + [(30, 1.0, 2.0, 190.0, 0.0, "c9", nan), (31, 1.0, 2.0, None, 0.0, "c8", None), (32, *rows[3][1:])], schema)
    got = found(odd, ["a", "b"])
    assert got["target_not_finite"][0] == 2 and got["coordinates"][0] == 2 and got["repeated_rows"][0] == 1 and got["repeated_places"][0] == 1 and got["groups"][0] == 0
    assert found(fine.where("cell < 'c2'"), ["a"])["groups"][0] == 2
    with pytest.raises(ValueError):
        preflight.passed(preflight.preflight(odd, "key", "target", ["a"], "lat", "lon", "cell", 4))
    assert found(fine.where("1 = 0"), ["a"])["all_missing"] == (1, "a")


def test_draws_weigh_counts_side_by_side(spark, monkeypatch):
    """Blocks of replicates give what a row for each replicate gives, the last block short."""
    monkeypatch.setattr(paired, "BLOCK", 8)
    r = random.Random(4)
    counts = spark.createDataFrame([(k, f"g{r.randrange(9)}", r.randrange(2), r.choice(["reference", "candidate"]), r.randrange(5) / 4, float(r.randint(1, 3))) for k in "ab" for _ in range(80)], "k string, cell string, y int, __arm string, score double, n double")
    weights = paired.group_draws(counts.select("k", "cell").distinct(), ["k"], "cell", 21, "s")
    plain = counts.join(weights, ["k", "cell"]).groupBy("k", "rep", "__arm", "y", "score").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    got = paired._drawn(counts, weights, ["k"], "cell", 21).select(*plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.select("rep").distinct().count() == 21
