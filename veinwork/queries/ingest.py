"""Queries of sources, harmonising ingest, alignment, sinks and streaming. Files are written from the tables first, then read as a user's would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators import aggregates as a
from veinwork.operators import ingest as g
from veinwork.operators import windows as w
from veinwork.sources import tables as t
from veinwork.sources.scratch import folder
from veinwork.streaming import ingest as stream

from .registry import query

#: Headers of the two layouts in which exports are written; the second has single coordinates, the third lacks the target.
RANGES = {"sample_name": "SAMPLE NAME", "material": "TYPE OF MATERIAL", "li": "LI(PPM)", "lon_min": "LONGITUDE MIN", "lon_max": "Longitude_max", "lat_min": "LATITUDE MIN", "lat_max": "Latitude_Max", "FeOT": "FEOT(WT%)", "Rb": "RB(PPM)"}
POINTS = {"sample_name": "Sample", "material": "Material", "li": "Li_icpms", "lon_min": "Longitude (X)", "lat_min": "Latitude (Y)", "FeOT": "FeOT(wt%)", "Rb": "Rb"}


def files(export: DataFrame) -> str:
    """The export as CSV files of several layouts and encodings; where they are."""
    at = folder(export.sparkSession, "exports")
    named = lambda df, names, drop: df.select("id", "file_no", *(F.col(k).alias(v) for k, v in names.items() if k not in drop), *(F.col(x).alias(f"{x.upper()}(WT%)") for x in c.OXIDES))
    for k, (names, drop, encoding) in enumerate([(RANGES, (), "UTF-8"), (RANGES, (), "UTF-8"), (POINTS, (), "ISO-8859-1"), (RANGES, ("li",), "UTF-8")]):
        named(export.where(f"file_no = '{k}'"), names, drop).write.csv(f"{at}/f{k}", header=True, encoding=encoding)
    return at


def exports(export: DataFrame) -> DataFrame:
    return t.read_exports(export.sparkSession, f"{files(export)}/*", multi_line=False)


_NUM = lambda x: f"try_cast({x} as double)"
_FE = f"coalesce({_NUM('FeOT')} * 1.111348e0, {_NUM('Fe2O3')})"
_OX = [_FE if x == "Fe2O3" else _NUM(x) for x in c.OXIDES]
_PRESENT = " + ".join(f"(({x}) is not null)::int" for x in [*_OX, _NUM("Rb")])
CODE = r"case when upper(trim(material)) = 'WHOLE ROCK' then 'WR' when upper(trim(material)) = 'VOLCANIC GLASS' then 'GL' else nullif(regexp_extract(upper(trim(material)), '^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$', 1), '') end"
def _verdicts(points: str, skipped: str) -> str:
    """CTEs v and h: every row with its verdict. points: the file with single coordinates; skipped: the one without a target."""
    mid = lambda x: f"case when file_no = '{points}' then {_NUM(x + '_min')} else ({_NUM(x + '_min')} + coalesce({_NUM(x + '_max')}, {_NUM(x + '_min')})) / 2 end as {x}"
    return f"""v as (select *, {CODE} as code, {_NUM('li')} as li_n, {mid('lon')}, {mid('lat')}, {' + '.join(_OX)} as total, {_PRESENT} as n from export where file_no <> '{skipped}'),
    h as (select *, case when code is distinct from 'WR' then 'material' when li_n is null or lon is null or lat is null then 'missing_core' when lon not between -180 and 180 or lat not between -90 and 90 then 'bad_coordinates' when n < 6 then 'too_few_predictors' end as reject from v)"""


_V = _verdicts("2", "3")


def rows(export: DataFrame) -> DataFrame:
    return g.harmonised(exports(export), "EXPORT", minimum_predictors=6, feot_equivalent=True)


@query("a01_tabular_load", "export", "select file_no, count(*) as n, count(distinct sample_name) as names, min(sample_name) as first_name from export where file_no <> '3' group by 1")
def a01(export):
    return exports(export).groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_name").alias("names"), F.min("sample_name").alias("first_name"))


@query("a02_encodings", "export", "select distinct file_no, case when file_no = '2' then 'ISO-8859-1' else 'UTF-8' end as encoding from export")
def a02(export):
    spark = export.sparkSession
    return t.encodings(spark, f"{files(export)}/*").select(F.regexp_extract("path", r"/f(\d)/", 1).alias("file_no"), "encoding").distinct()


@query("a03_ingest_audit", "export", f"with {_V} select file_no, count(*) as rows_read, count(*) filter (reject is null) as rows_kept, " + ", ".join(f"count(*) filter (reject = '{r}') as rejected_{r}" for r in g.REASONS) + " from h group by file_no")
def a03(export):
    return g.audit(rows(export), "file_no")


@query("a04_core_columns", "export", "select distinct file_no, case when file_no = '3' then 'Li_icpms' else '' end as missing from export")
def a04(export):
    heads = t.layouts(export.sparkSession, f"{files(export)}/*").select(F.regexp_extract("path", r"/f(\d)/", 1).alias("file_no"), "header").distinct()
    # a row per layout of a folder
    return export.sparkSession.createDataFrame(sorted({(r.file_no, ",".join(t.missing_core(t.header_names(r.header)))) for r in heads.collect()}), "file_no string, missing string")


@query("b10_harmonised_rows", "export", f"with {_V} select id, file_no, li_n as li, lon, lat, total, case when {_NUM('FeOT')} is not null then 'FEOT_CONVERTED_TO_FE2O3T' else 'ORIGINAL_FE2O3' end as iron, 'EXPORT' as source_dataset from h where reject is null")
def b10(export):
    return g.kept(rows(export)).select("id", "file_no", F.col("Li_icpms").alias("li"), F.col("Longitude").alias("lon"), F.col("Latitude").alias("lat"), F.col("oxide_sum").alias("total"), F.col("iron_provenance").alias("iron"), "source_dataset")


_BASE = "b as (select cast(sample_id as varchar) as id, li, lon, lat from oxides where li is not null)"


def _base(oxides):
    return oxides.where("li is not null").select(F.col("sample_id").cast("string").alias("id"), "li", "lon", "lat")


@query("a05_merge_sources", "oxides export", f"with {_V}, {_BASE}, u as (select id, 'base' as origin from b union all select id, 'external' from h where reject is null) select count(*) filter (origin = 'base') as base_rows, count(*) filter (origin = 'external') as external_rows, count(*) as combined_rows, count(distinct id) as unique_rows, count(*) - count(distinct id) as duplicates from u")
def a05(oxides, export):
    return g.merged(_base(oxides), b10(export).select("id", "li", "lon", "lat"), ["id"], ["id"])[1]


@query("n26_staged_inspection", "oxides export", f"with {_V}, {_BASE}, k as (select id from h where reject is null) select 'read' as stage, count(*) as n from h union all select 'kept', count(*) from k union all select 'concatenated', (select count(*) from k) + (select count(*) from b) union all select 'deduplicated', count(distinct id) from (select id from k union all select id from b)")
def n26(oxides, export):
    read = rows(export)
    good = g.kept(read).select("id")
    both = good.unionByName(_base(oxides).select("id"))
    return a.stage_audit({"read": read, "kept": good, "concatenated": both, "deduplicated": w.keep_first(both, ["id"], ["id"])}).select("stage", F.col("rows").alias("n"))


@query("a06_export_postprocess", "export", f"with {_V} select count(*) as rows, count(*) - count(distinct id) as repeated, count(*) filter (li_n is null) as missing_li, count(*) filter (lon is null) as missing_lon from h where code = 'WR'")
def a06(export):
    whole = rows(export).where("material_code = 'WR'")
    return g.health(whole.withColumnsRenamed({"Li_icpms": "li", "Longitude": "lon"}), ["id"], ["li", "lon"])


@query("a07_configured_adapter", "export", "select id as sample, try_cast(li as double) * 10000 as Li_ppm, lon_min as lon_text, file_no, 'survey' as provenance from export")
def a07(export):
    return g.adapted(export, {"sample": "id", "Li_ppm": "li", "lon_text": "lon_min"}, {"Li_ppm": 10000.0}, ["file_no", "absent"], {"provenance": "survey"})


@query("a08_table_manifest", "raw", "select count(*) as rows, 16 as columns, count(distinct path) as linked from raw")
def a08(raw):
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(raw.columns)).alias("columns"), F.countDistinct("path").alias("linked"))


_DIGEST = "s as (select substr(md5(line), 1, 3) as share, sha256(string_agg(line, chr(10) order by line)) as d from l group by 1) select sha256(string_agg(share || '|' || d, chr(10) order by share || '|' || d)) as digest from s"


@query("a09_set_fingerprint", "raw", f"with l as (select path || '|' || sha256(value) as line from raw), {_DIGEST}")
def a09(raw):
    return t.set_digest(raw.select("path", F.sha2("value", 256).alias("sha256")))


@query("n27_linked_patch_identity", "raw", f"with l as (select id || '|' || path || '|' || case when rock is null then 'MISSING' else sha256(rock) end as line from raw), {_DIGEST}")
def n27(raw):
    return t.set_digest(raw.select(F.concat_ws("|", F.col("id").cast("string"), "path").alias("path"), F.sha2("rock", 256).alias("sha256")))


@query("a10_feature_cache", "oxides", "select sample_id, Na2O + K2O as Alkali_Sum from oxides")
def a10(oxides):
    at = folder(oxides.sparkSession, "features")
    features = oxides.select("sample_id", c.derived_features()["Alkali_Sum"].alias("Alkali_Sum"))
    t.cached_by_signature(features, "v1-6bands", at)
    # the second call reads what the first one stored
    return t.cached_by_signature(features.where("1 = 0"), "v1-6bands", at)


def _runs(geo):
    at = folder(geo.sparkSession, "runs")
    runs = geo.select(F.concat(F.lit("run_"), F.col("sample_id").cast("string")).alias("run_id"), F.col("source").alias("model_group"), F.when(F.col("publication") % 3 == 0, "failed").otherwise("completed").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("finished"), F.when(F.col("publication") % 5 == 0, F.array(F.lit("svm"))).otherwise(F.array().cast("array<string>")).alias("failed"))
    runs.write.json(at)
    return t.run_catalog(geo.sparkSession, at, multi_line=False)


_RUNS = "r as (select 'run_' || sample_id as run_id, source as model_group, publication % 3 <> 0 and publication % 5 <> 0 as ok, publication % 3 <> 0 as completed, publication, strftime(ts, '%Y-%m-%d %H:%M:%S') as finished from geo)"


@query("a11_run_catalog", "geo", f"with {_RUNS} select model_group, count(*) as runs, count(*) filter (ok) as candidates from r group by 1")
def a11(geo):
    return _runs(geo).groupBy("model_group").agg(F.count(F.lit(1)).alias("runs"), F.count_if("release_candidate").alias("candidates"))


@query("a12_latest_candidate", "geo", f"with {_RUNS} select model_group, max(finished) as finished from r where ok group by 1")
def a12(geo):
    runs = _runs(geo)
    return t.latest(runs, "model_group").join(runs, ["run_id", "model_group"]).select("model_group", "finished")


@query("f20_latest_compatible", "geo", f"with {_RUNS} select publication as signature, arg_max(run_id, finished || run_id) as run_id from r where completed group by 1")
def f20(geo):
    runs = _runs(geo).join(geo.select(F.concat(F.lit("run_"), F.col("sample_id").cast("string")).alias("run_id"), F.col("publication").alias("signature")), "run_id")
    return t.latest_compatible(runs, "signature", "status", "finished")


@query("a13_bibliography", "raw", r"select regexp_extract(citation, '^\[(\d+)\]', 1) as ref, count(*) as n, min(trim(substr(citation, strpos(citation, ']') + 1))) as first_text from raw group by 1")
def a13(raw):
    return t.bibliography(raw, "citation").groupBy(F.col("id").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.min("citation").alias("first_text"))


_SCENES = "s as (select id, case when id % 7 = 0 then null else (id % 100) * 1e0 end as cloud, (id % 9) * 1e0 as nodata, b.band, case when id % 5 = 0 and b.band = 'B04' then null else 0.0001e0 end as scale, b.off as off from raw, (values ('B04', -0.1e0), ('B08', 0e0)) b(band, off))"


@query("a14_scene_metadata", "raw", f"with {_SCENES} select 's' || id as scene_id, cloud, nodata, band, scale, off as offset_value, cloud is not null and scale is not null as complete from s")
def a14(raw):
    at = folder(raw.sparkSession, "scenes")
    band = lambda off, hide: F.struct(F.array(F.struct(F.when(~hide, F.lit(0.0001)).alias("scale"), F.lit(off).alias("offset"))).alias("raster:bands"))
    assets = F.create_map(F.lit("B04"), band(-0.1, F.col("id") % 5 == 0), F.lit("B08"), band(0.0, F.lit(False)))
    properties = F.struct(F.when(F.col("id") % 7 != 0, (F.col("id") % 100).cast("double")).alias("eo:cloud_cover"), (F.col("id") % 9).cast("double").alias("s2:nodata_pixel_percentage"))
    raw.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), properties.alias("properties"), assets.alias("assets")).write.json(at)
    return t.scenes(raw.sparkSession, at, multi_line=False).withColumnRenamed("offset", "offset_value")


@query("a15_match_files", "oxides raw", r"select sample_id, source, path from oxides join raw on regexp_replace(regexp_extract(replace(path, chr(92), '/'), '([^/]*)$', 1), '\.[^.]*$', '') = case when li is null then 'none' || sample_id else cast(sample_id as varchar) end")
def a15(oxides, raw):
    return t.match_files(oxides.withColumn("key", F.concat(F.when(F.col("li").isNull(), "none").otherwise(""), F.col("sample_id").cast("string"))), raw, "key").select("sample_id", "source", "path")


@query("a16_evidence_pool", "oxides", """with p as (select sample_id as id, material, li, 'table' as origin from oxides where source <> 'Brand#11' union all select sample_id, material, li, 'feature' from oxides where source < 'Brand#3'), o as (select id, count(distinct origin) as k from p group by 1)
    select material, case when k > 1 then 'duplicate' when li is null then 'no_value' else 'admitted' end as admission, count(*) as n, sum(li) as total from p join o using (id) group by 1, 2""")
def a16(oxides):
    at = folder(oxides.sparkSession, "evidence")
    one = F.struct(F.struct(F.col("sample_id").alias("id"), "material", "li").alias("attributes"))
    oxides.where("source < 'Brand#3'").groupBy((F.col("sample_id") % 97).alias("sheet")).agg(F.collect_list(one).alias("features")).write.json(f"{at}/features")
    oxides.where("source <> 'Brand#11'").select(F.col("sample_id").alias("id"), "material", "li").write.csv(f"{at}/table", header=True)
    spark = oxides.sparkSession
    features = spark.read.schema("features array<struct<attributes: struct<id: bigint, material: string, li: double>>>").json(f"{at}/features")
    table = spark.read.csv(f"{at}/table", header=True, schema="id bigint, material string, li double")
    return t.evidence_pool(table, features).groupBy("material", "admission").agg(F.count(F.lit(1)).alias("n"), F.sum("li").alias("total"))


@query("a17_quarantine", "oxides", "select li is not null and li > 5 as passed, count(*) as n from oxides group by 1")
def a17(oxides):
    at = folder(oxides.sparkSession, "quarantine")
    t.quarantine(oxides, F.col("li") > 5, f"{at}/good", f"{at}/bad")
    read = lambda x: oxides.sparkSession.read.parquet(f"{at}/{x}")
    return read("good").withColumn("passed", F.lit(True)).unionByName(read("bad").withColumn("passed", F.lit(False))).groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


@query("a18_prediction_sink", "oof", "select count(*) as n, count(coarse) as scored, avg(coarse) as mean, min(coarse) as low, max(coarse) as high from oof")
def a18(oof):
    return t.write_predictions(oof.select("sample_id", "coarse"), "sample_id", "coarse", folder(oof.sparkSession, "predictions")).drop("digest")


@query("b03_age_gate", "raw", "select avg((lower(trim(age)) in ('', 'nan', 'none', 'null', 'na', 'n/a', '-'))::int) as missing, avg((lower(trim(age)) in ('', 'nan', 'none', 'null', 'na', 'n/a', '-'))::int) <= 0.5 as include_age from raw")
def b03(raw):
    return g.age_gate(raw, "age")


@query("b04_first_alias", "raw", "select id, lon_a as lon from raw")
def b04(raw):
    return raw.select("id", F.col(t.first_alias(raw.columns, ["Longitude", " LON_A ", "lon_b"])).alias("lon"))


@query("b06_header_map", "export", "select count(li) as li, count(lon_min) as lon, count(Rb) as rb from export where file_no <> '3'")
def b06(export):
    x = exports(export)
    return x.agg(F.count("Li_icpms").alias("li"), F.count(F.coalesce("Longitude", "Longitude_min")).alias("lon"), F.count("Rb_icpms").alias("rb"))


@query("b09_material_label", "export", f"select id, {CODE} as code, case {CODE} when 'WR' then 'WHOLE ROCK' when 'GL' then 'VOLCANIC GLASS' end as label from export")
def b09(export):
    return export.select("id", c.material_code("material").alias("code"), c.material_label(c.material_code("material")).alias("label"))


@query("b17_feature_schema", "oxides", f"select {', '.join(c.OXIDES)}, Na2O + K2O as Alkali_Sum from oxides")
def b17(oxides):
    made = oxides.withColumn("Alkali_Sum", c.derived_features()["Alkali_Sum"]).withColumn("Age", F.lit(1))
    return made.select(*g.feature_schema(made.columns, include_age=False))


@query("b18_predict_align", "export", r"""select try_cast(SiO2 as double) as SiO2, try_cast(FeOT as double) as FeOT, cast(null as double) as Age, case when coalesce(trim(material), '') = '' then 'unknown' else lower(trim(material)) end as material from export""")
def b18(export):
    return g.aligned(export, {"SiO2": "double", "feot": "double", "Age": "double", "material": "string"}).withColumnRenamed("feot", "FeOT")


@query("b42_case_narrative", "paired", "select case_id, 'Case ' || case_id || ': ' || case when score >= 0.7e0 then 'high' when score >= 0.4e0 then 'middle' else 'low' end || ' score' || case when low_q90 is null then ', no interval' else ', interval given' end || '.' as narrative from paired")
def b42(paired):
    level = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "middle").otherwise("low")
    return paired.select("case_id", F.concat(F.format_string("Case %d: %s score", "case_id", level), F.when(F.col("low_q90").isNull(), ", no interval").otherwise(", interval given"), F.lit(".")).alias("narrative"))


@query("s01_s02_stream_ingest", "export", f"with {_verdicts('', '')} select file_no, count(*) as n, sum(li_n) as li from h where reject is null group by 1")
def s01(export):
    """Files arrive in two lots; the second run goes on where the first stopped."""
    spark = export.sparkSession
    at = folder(spark, "stream")
    schema = "id string, file_no string, material string, Li_icpms string, Longitude_min string, Longitude_max string, Latitude_min string, Latitude_max string, FeOT string, Rb_icpms string, " + ", ".join(f"{x} string" for x in c.OXIDES)
    named = export.select("id", "file_no", "material", F.col("li").alias("Li_icpms"), F.col("lon_min").alias("Longitude_min"), F.col("lon_max").alias("Longitude_max"), F.col("lat_min").alias("Latitude_min"), F.col("lat_max").alias("Latitude_max"), "FeOT", F.col("Rb").alias("Rb_icpms"), *c.OXIDES)
    for lot in ("file_no < '2'", "file_no >= '2'"):
        named.where(lot).write.csv(f"{at}/in", header=True, mode="append")
        chain = lambda df: g.kept(g.harmonised(df, "EXPORT", minimum_predictors=6, feot_equivalent=True)).select("id", "file_no", "Li_icpms")
        stream.ingest(spark, f"{at}/in", schema, chain, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("Li_icpms").alias("li"))


@query("s03_idempotent_upsert", "geo", "select publication, max(sample_id) as sample_id, arg_max(li, sample_id) as li from geo group by publication")
def s03(geo):
    """Samples of a publication replace its former one, in a stream that is stopped and resumed between three lots by time. The second brings rows
    again that are late by then and would win, the third rows of the second's last month with other values, which the state knows; the
    last batch is sent twice. None of these changes anything."""
    spark = geo.sparkSession
    at, rows = folder(spark, "upsert"), geo.select("publication", "sample_id", "li", F.col("ts").cast("timestamp").alias("ts"))
    cut = F.percentile_approx(F.col("ts").cast("double"), F.array(F.lit(1 / 3), F.lit(2 / 3)))
    one, two = rows.agg(cut.alias("c")).first().c
    time = F.col("ts").cast("double")
    month = 30 * 86400.0
    late = rows.where(time < one).select("publication", (F.col("sample_id") + 10**9).alias("sample_id"), F.lit(-1.0).alias("li"), (F.col("ts") - F.expr("interval 400 days")).alias("ts"))
    again = rows.where((time >= one) & (time < two) & (time > two - month)).withColumn("li", F.col("li") + 5000)
    lots = [rows.where(time < one), rows.where((time >= one) & (time < two)).unionByName(late), rows.where(time >= two).unionByName(again)]
    for lot in lots:
        lot.write.mode("append").parquet(f"{at}/in")
        stream.upserting(spark, f"{at}/in", "publication bigint, sample_id bigint, li double, ts timestamp", "ts", ["publication"], "sample_id", f"{at}/out", f"{at}/checkpoint", "30 days", files_a_batch=10_000).awaitTermination()
    last = stream.versions(spark, f"{at}/out")[-1][0]
    stream.upsert(f"{at}/out", ["publication"], "sample_id")(late.drop("ts").withColumn("ts", F.current_timestamp()), last)
    stream.pruned(spark, f"{at}/out")
    return stream.upserted(spark, f"{at}/out").select("publication", "sample_id", "li")


@query("s04_status_counts", "geo", "select case when li > 100e0 then 'failed' else 'scored' end as status, count(*) as n from geo group by 1")
def s04(geo):
    spark = geo.sparkSession
    at = folder(spark, "status")
    geo.select(F.when(F.col("li") > 100, "failed").otherwise("scored").alias("status")).write.parquet(f"{at}/in")
    counts = stream.status_counts(spark.readStream.schema("status string").parquet(f"{at}/in"), "status")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
