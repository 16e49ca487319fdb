"""Preprocessing and fits on small tables."""

from pyspark.ml import Pipeline, PipelineModel

import __spark_entry__ as entry
from veinwork.plans import modelling


def test_medians_are_exact(spark, tmp_path):
    rows = [(i, float(v) if v is not None else None, v and -v / 8, None) for i, v in enumerate([1, 2, 3, 10, None])] + [(5, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    model = Pipeline(stages=modelling.preprocessor(["a", "b", "c"])).fit(df)
    model.write().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        got = {r.id: (r.a__i, r.b__i, r.c__i) for r in m.transform(df).collect()}
        assert got[4] == got[5] == (2.5, -0.3125, None) and got[0] == (1.0, -0.125, None) and got[3] == (10.0, -1.25, None)


def test_j01_of_an_even_number_of_rows(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("create table part as select i::bigint as p_partkey, 'n' as p_name, 'b' || i % 3 as p_brand, 't' as p_type, 1 as p_size, 1e0 as p_retailprice from range(8) r(i)")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    want = sorted(con.execute(entry.oracle_sql()["j01_preprocessor"]).fetchall())
    got = sorted(map(tuple, entry.queries()["j01_preprocessor"](spark, str(tmp_path)).collect()))
    assert got == want and any(r[1] == 48.5 for r in want)


def test_fits_deal_their_rows(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(modelling, "FIT_ROWS", 50)
    fitted = []
    for kind in (modelling.RandomForestRegressor, modelling.GBTRegressor, modelling.LinearRegression):
        monkeypatch.setattr(kind, "fit", lambda self, rows, params=None, f=kind.fit: fitted.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]) or f(self, rows))
    df = spark.range(0, 600, 1, 1).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 2.0).alias("target"))
    got = modelling.competition(df, "id", "target", modelling.preprocessor(["x"]), 3, "regression").collect()
    assert len(got) == 9 and all(r.n == 200 and r.rmse < 5 for r in got)
    assert [r.importance for r in modelling.importances(df, "id", "target", ["x"]).collect()] == [1.0]
    assert len(fitted) == 10 and all(sum(parts) in (400, 600) and max(parts) < 90 for parts in fitted)
