"""Operators on tiny literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import aggregates, decisions, folds, joins, metrics, raster, windows
from veinwork.sources import tables


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_detection_limits_and_missing(spark):
    d = spark.createDataFrame([("<3",), (">4.5",), (" 7 ",), ("< x",), (None,), ("N/A",)], "v string")
    assert values(d.select(c.detection_limit("v").alias("o")), "o") == ["1.5", "4.5", "7", "< x", None, "N/A"]
    assert values(d.select(c.missing_to_null("v").alias("o")), "o")[-1] is None
    assert values(d.select(c.number("v").alias("o")), "o") == [None, None, 7.0, None, None, None]


def test_material_and_rules(spark):
    d = spark.createDataFrame([("WR",), ("/ wr [3]",), ("Volcanic glass",), ("basalt",), (None,)], "m string")
    assert values(d.select(c.material_code("m").alias("a"), c.material_batch("m").alias("b")), "a", "b") == [("WR", None), ("WR", "3"), ("GL", None), (None, None), (None, None)]
    assert values(d.select(c.by_rules("m").alias("o")), "o") == ["other", "other", "other", "volcanic", "unknown"]


def test_protocols(spark):
    full = dict.fromkeys(c.OXIDES, 9.8) | {"measured_total": None, "Rb": 1.0, "Sr": 2.0, "source": "s"}
    rows = [full | {"measured_total": 99.0}, full, full | {"MnO": None}, full | {"SiO2": None}, full | {"MnO": None, "Rb": None}]
    schema = ", ".join(f"{k} double" for k in [*c.OXIDES, "measured_total", "Rb", "Sr"]) + ", source string"
    d = spark.createDataFrame([tuple(r[x.split()[0]] for x in schema.split(", ")) for r in rows], schema)
    assert [s[0] for s in values(aggregates.protocol_masks(d), "qc_status")] == ["A", "B", "C", "R", "R"]
    got = {(r.protocol, r.rows, r.additional) for r in aggregates.protocol_summary(aggregates.protocol_masks(d)).collect()}
    assert got == {("A_original", 1, 0), ("B_reconstructed", 2, 1), ("C_experimental", 3, 2)}


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    with pytest.raises(joins.ContractError):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(joins.ContractError):
        joins.many_to_one(a, b, ["k"])
    assert joins.unambiguous(a, b, ["k"]).count() == 0


def haversine(p, q):
    la, lb = math.radians(p[0]), math.radians(q[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * c.EARTH_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("km", [5.0, 400.0])
def test_radius_and_nearest_match_brute_force(spark, km):
    import random

    r = random.Random(1)
    near = lambda n, at: [(i, max(-90.0, min(90.0, r.gauss(at[0], 2))), (r.gauss(at[1], 3) + 180) % 360 - 180) for i in range(n)]
    left, right = near(60, (0, 179.5)) + [(100 + i, a, o) for i, a, o in near(40, (88.5, 10))], near(80, (0.5, -179.8)) + [(100 + i, a, o) for i, a, o in near(40, (89, -170))]
    left.append((500, None, 1.0))
    L = spark.createDataFrame(left, "id int, lat double, lon double")
    R = spark.createDataFrame(right, "rid int, r_lat double, r_lon double")
    want = {(i, j) for i, a, o in left if a is not None for j, b, p in right if haversine((a, o), (b, p)) <= km}
    assert {(x.id, x.rid) for x in joins.radius_pairs(L, R, km).collect()} == want
    best = {i: min((haversine((a, o), (b, p)), j) for j, b, p in right) for i, a, o in left if a is not None}
    got = {x.id: (x.distance_km, x.rid) for x in joins.nearest(L, R, "id", "rid").collect()}
    assert got.keys() == best.keys() and all(abs(got[i][0] - best[i][0]) < 1e-6 for i in best)


def test_ranking_against_definition(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("a", 0, 0.4), ("b", 1, 0.5)]
    d = spark.createDataFrame(rows, "g string, y int, score double")
    out = {r.g: r for r in metrics.ranking(d, ["g"]).collect()}
    pos, neg = [s for g, y, s in rows if g == "a" and y], [s for g, y, s in rows if g == "a" and not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(out["a"].auc, auc) and math.isclose(out["a"].ap, 0.5 * 1 / 2 + 0.5 * 2 / 4) and out["b"].auc is None


def test_threshold_prefers_the_rule(spark):
    d = spark.createDataFrame([(0, 0.2), (0, 0.4), (1, 0.6), (1, 0.8)], "y int, score double")
    assert metrics.operating_threshold(d, []).first().threshold == 0.5
    assert metrics.operating_threshold(d.where("y = 1"), []).count() == 0


def test_folds_are_balanced_and_isolated(spark):
    d = spark.createDataFrame([(i, f"c{i % 7}") for i in range(70)], "id int, cell string")
    f = folds.group_folds(d, "cell", 3)
    assert f.count() == 7 and {r.fold for r in f.collect()} == {0, 1, 2}
    assert decisions.isolated(d.join(f, "cell"), "cell").count() == 0
    assert decisions.complete_once(d, d, "id").count() == 0 and decisions.complete_once(d, d.where("id > 3"), "id").count() == 4


def test_bootstrap_is_deterministic(spark):
    d = spark.createDataFrame([(i % 5, float(i), float(i % 3)) for i in range(50)], "g int, y double, pred double")
    a, b = folds.bootstrap_mae(d, "g", 20).first(), folds.bootstrap_mae(d.repartition(3), "g", 20).first()
    assert abs(a.low - b.low) < 1e-9 and a.low <= a.median <= a.high and a.replicates == 20


def test_two_stage_abstains(spark):
    make = lambda *r: spark.createDataFrame(list(r), "k long, a double, b double")
    say = lambda d: tuple(decisions.two_stage(d, "k", "a", "b").first())[:2]
    assert say(make((1, 5.0, 0.1), (2, 4.0, 0.9), (3, 3.0, 0.5), (4, 1.0, 1.0))) == ("decided", 2)
    assert say(make((1, 5.0, 0.1), (2, 4.0, 0.9)))[0] == "too_few_valid"
    assert say(make((1, 5.0, 0.9), (2, 4.0, 0.9), (3, 3.0, 0.5)))[0] == "tie"
    assert say(make((1, 5.0, None), (2, 4.0, None), (3, 3.0, 0.5)))[0] == "too_few_scored"


def test_keep_first_treats_nulls_alike(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i int, k string")
    assert sorted(values(windows.keep_first(d, ["k"], ["i"]), "i")) == [1, 3]
    assert sorted(values(windows.multiplicity(d, ["k"]), "n_same")) == [2, 2, 2, 2]


def test_pixels_fill_and_texture(spark):
    px = spark.createDataFrame([("i", "red", y, x, float(y * 2 + x) if (y, x) != (1, 1) else float("nan")) for y in range(2) for x in range(2)], "image_id string, band string, y int, x int, v double")
    assert {(r.y, r.x): r.v for r in raster.filled(px).collect()}[(1, 1)] == 1.0
    t = raster.texture(raster.filled(px)).first()
    assert math.isclose(t.texture_mean, (2 + 0 + 1 + 1) / 4)


def test_exports_are_harmonised(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("SAMPLE NAME,LI(PPM),LONGITUDE,LATITUDE\nañ,5,1,2\n".encode())
    (tmp_path / "b.csv").write_bytes("Sample,LI,LONGITUDE MIN,LATITUDE MIN,SIO2(WT%)\nbñ €,6,3,4,55\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"x,y\n1,2\n")
    d = tables.read_exports(spark, f"file://{tmp_path}/*.csv")
    assert {(r.sample_name, r.Li_icpms) for r in d.collect()} == {("añ", "5"), ("bñ €", "6")} and "SiO2" in d.columns
    assert tables.missing_core(["x"]) == ["Li_icpms", "Longitude", "Latitude"]
    files = tables.manifest(spark, f"file://{tmp_path}/*.csv").select("path", "sha256")
    assert files.count() == 3 and tables.set_digest(files).first().digest == tables.set_digest(files.repartition(3)).first().digest


def test_streaming_ingest_resumes(spark, tmp_path):
    from veinwork.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text("id,v\n1,<4\n")
    go = lambda: ingest.ingest(spark, str(src), "id int, v string", lambda d: d.withColumn("v", c.detection_limit("v")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (src / "2.csv").write_text("id,v\n2,8\n")
    go()
    assert sorted((r.id, float(r.v)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2.0), (2, 8.0)]
    up, at = ingest.upsert(str(tmp_path / "up"), ["id"], "v"), str(tmp_path / "up")
    for _ in range(2):
        up(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string"), 0)
    assert ingest.upserted(spark, at).count() == 3
    up(spark.createDataFrame([(1, "z"), (None, "d"), (3, "y"), (2, "a")], "id int, v string"), 1)
    assert {(r.id, r.v) for r in ingest.upserted(spark, at).collect()} == {(1, "z"), (2, "b"), (3, "y"), (None, "d")}
    assert F is not None


def test_radius_meets_over_the_date_line(spark):
    left = spark.createDataFrame([(1, 55.0, -180.0), (2, 45.0, -180.0)], "a int, lat double, lon double")
    right = spark.createDataFrame([(1, 55.0, 179.962), (2, 45.0, 179.963)], "b int, r_lat double, r_lon double")
    assert sorted((r.a, r.b) for r in joins.radius_pairs(left, right, 3.0).collect()) == [(1, 1), (2, 2)]


def test_distinct_counts_keep_no_sketch_by_pair(spark):
    from veinwork.queries import evidence

    df = spark.createDataFrame([("a", i % 7) for i in range(50)] + [("b", None), ("b", None), (None, 1), (None, None)], "source string, publication bigint")
    got = evidence.e51(df)
    assert {r.source: (r.publications, r.approximation_near) for r in got.collect()} == {"a": (7, True), "b": (0, True), None: (1, True)}
    sketches = [x for x in got._jdf.queryExecution().sparkPlan().toString().split("\n") if "hyperloglog" in x.lower() or "approx_count" in x.lower()]
    assert sketches and not any("keys=[source" in x and "publication" in x.split("functions=")[0] for x in sketches)


def test_arms_multiply_no_rows_before_joins(spark):
    import random

    from veinwork.operators import evidence

    r = random.Random(5)
    rows = [(i, r.randrange(4), r.choice(["s1", "s2", "s3", None, f"t{i}"]), f"p{i % 9}", r.choice([0, 1, None]) if i % 9 < 5 else 1, None if i % 9 == 8 else float(i % 9), float(i % 9) * 0.04, i / 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, fold int, scene string, site string, label int, lat double, lon double, li double").repartition(3)
    arms = evidence.arm_rows(df, 4, "id", "scene", "site", "label", arms=("all", "no_shared_scenes", "no_mixed_sites"), keep=("li",))
    train = [(t, x) for t in range(4) for x in rows if x[1] != t]
    labels = {(t, s): {x[4] for k, x in train if k == t and x[3] == s} - {None} for t in range(4) for s in {x[3] for x in rows}}
    want = {("all", t, x[0], x[7]) for t, x in train}
    want |= {("no_shared_scenes", t, x[0], x[7]) for t, x in train if x[2] is None or all(z[2] != x[2] for z in rows if z[1] == t)}
    want |= {("no_mixed_sites", t, x[0], x[7]) for t, x in train if len(labels[t, x[3]]) < 2}
    assert sorted(map(tuple, arms.collect())) == sorted(want)
