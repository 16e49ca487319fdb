"""Ordered operators, harmonising ingest, audits and arms: hand cases and plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veinwork.operators import evidence, ingest, joins, ordered
from veinwork.sources import tables


def quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] + (v[hi] - v[lo]) * (at - lo)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_and_numbers_match_plain_python(spark, keys):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else float(r.randrange(60))) for _ in range(700)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g if keys else ""].append(v)
    got = {(x.g if keys else ""): (x.lo, x.mid) for x in ordered.quantiles(d, keys, F.col("v"), {"lo": 0.13, "mid": 0.5}).collect()}
    assert got.keys() == groups.keys() and all(got[k] == pytest.approx((quantile(v, 0.13), quantile(v, 0.5))) for k, v in groups.items())
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(150)], "name string").repartition(7)
    assert {x.name: x.at for x in ordered.numbered(names, ["name"], "at").collect()} == {f"n{i:03d}": i for i in range(150)}
    assert ordered.quantiles(d.where("1 = 0"), keys, F.col("v"), {"lo": 0.5}).where("lo is not null").count() == 0


def test_each_row_gets_its_first_reason(spark):
    rows = [("1", "WR", "5", "10", None, "20"), ("2", "GL", "5", "10", None, "20"), ("3", "wr [2]", "n.d.", "10", "12", "20"), ("4", "WHOLE ROCK", "5", "400", None, "20"), ("5", "WR", "5", "10", "12", None), ("6", None, "5", "10", None, "20")]
    d = spark.createDataFrame(rows, "id string, material string, Li_icpms string, Longitude_min string, Longitude_max string, Latitude string").withColumn("source_file", F.lit("f.csv"))
    out = {r.id: (r.reject, r.Longitude) for r in ingest.harmonised(d, "X", minimum_predictors=0).collect()}
    assert out == {"1": (None, 10.0), "2": ("material", 10.0), "3": ("missing_core", 11.0), "4": ("bad_coordinates", 400.0), "5": ("missing_core", 11.0), "6": ("material", 10.0)}
    audit = ingest.audit(ingest.harmonised(d, "X", minimum_predictors=3)).first()
    assert audit.rows_read == 6 and audit.rows_kept == 0 and audit.rejected_too_few_predictors == 1
    with pytest.raises(ValueError):
        ingest.adapted(d, {"a": "absent"}, {}, [], {})


def test_base_rows_win_a_merge(spark):
    base, other = (spark.createDataFrame(x, "id string, li double") for x in ([("1", 1.0), ("2", 2.0)], [("2", 9.0), ("3", 3.0), ("3", 4.0)]))
    out, audit = ingest.merged(base, other, ["id"], ["li"])
    assert {(r.id, r.li) for r in out.collect()} == {("1", 1.0), ("2", 2.0), ("3", 3.0)}
    assert audit.first().asDict() == {"base_rows": 2, "external_rows": 3, "combined_rows": 5, "unique_rows": 3, "duplicates": 2}


def test_layouts_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x,LI\n1,é\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes('﻿"LON, W",LI\n1,2\n'.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, tables.header_names(r.header)) for r in tables.layouts(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got == {"a.csv": ("ISO-8859-1", ["x", "LI"]), "b.csv": ("UTF-8", ["LON, W", "LI"])}
    assert tables.first_alias([" Lon ", "x"], ["longitude", "LON"]) == " Lon " and tables.first_alias(["x"], ["y"]) is None


OOF = "sample_id int, cell string, fold int, y int, score double"


def test_frozen_thresholds_refuse_leaks(spark):
    good = [(i, f"c{i % 9}", i % 9 % 3, int(i % 4 == 0), (i % 10) / 10) for i in range(90)]
    assert evidence.frozen_thresholds(spark.createDataFrame(good, OOF), 3).count() == 3
    for bad in ((99, "c0", 1, 1, 0.5), (99, "d", 1, 1, 1.5), (99, "d", 1, 1, None)):
        with pytest.raises(joins.ContractError):
            evidence.frozen_thresholds(spark.createDataFrame([*good, bad], OOF), 3)
    with pytest.raises(joins.ContractError):
        evidence.frozen_thresholds(spark.createDataFrame([(*r[:3], 0, r[4]) for r in good], OOF), 3)


def test_leaks_links_and_common_rows(spark):
    d = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 3.0, None), (None, 5.0, 5.0)], "t double, copy double, other double")
    assert {r.feature: r.leaks for r in evidence.leaking(d, "t", ["copy", "other"]).collect()} == {"copy": True, "other": False}
    right = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    left = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "k int, w double")
    assert {r.k: r.status for r in evidence.linked(left, right, ["k"], {"off": F.col("w") == F.col("v")}).collect()} == {1: "linked", 2: "conflict", 3: "unlinked"}
    with pytest.raises(joins.ContractError):
        evidence.linked(left, right.union(right), ["k"], {"off": F.lit(True)})
    arms = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 0, 0), (1, "b", 1, 0)], "k int, arm string, y int, fold int")
    assert sorted((r.k, r.arm) for r in evidence.common_rows(arms, "k", "arm", "y", "fold").collect()) == [(1, "a"), (1, "b")]
    with pytest.raises(joins.ContractError):
        evidence.common_rows(arms.union(spark.createDataFrame([(1, "c", 0, 0)], arms.schema)), "k", "arm", "y", "fold")


def test_a_pilot_keeps_its_distance(spark):
    rows = [(i, r, la, 0.0) for i, (r, la) in enumerate([("a", 0.0), ("a", 9.0), ("b", 0.1), ("c", 1.0), ("d", 1.05), ("e", 5.0)])]
    d = spark.createDataFrame(rows, "i int, ref string, lat double, lon double")
    assert [r.i for r in evidence.apart_pilot(d, "ref", [F.col("i")], 50.0, 8).collect()] == [0, 3, 5]
    assert [r.i for r in evidence.apart_pilot(d, "ref", [F.col("i")], 50.0, 2).collect()] == [0, 3]


def test_stratified_folds_hold_groups_and_classes(spark):
    rows = [(i, f"c{i % 40}", int(i % 40 % 4 == 0)) for i in range(800)]
    d = spark.createDataFrame(rows, "i int, cell string, y int")
    out = evidence.stratified_group_folds(d, "cell", "y", 5).collect()
    per = defaultdict(int)
    for r in out:
        per[r.fold] += int(r.cell[1:]) % 4 == 0
    assert len(out) == 40 and set(per.values()) == {2}


def test_pairs_near_training_rows(spark):
    rows = [(0, 0.0, 0.0, 0), (1, 0.0, 0.0, 1), (2, 10.0, 10.0, 0), (3, 10.0, 10.5, 2)]
    d = spark.createDataFrame(rows, "sample_id int, lat double, lon double, fold int")
    got = {r.sample_id: r.distance_km for r in evidence.nearest_training(d, "sample_id", "fold").collect()}
    assert got[0] == got[1] == 0 and got[2] == pytest.approx(got[3]) and 50 < got[2] < 60
