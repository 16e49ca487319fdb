"""Sources and sinks: assay exports with mixed encodings and headers, manifests, run catalogues, quarantine."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header aliases by canonical name, compared without blanks, underscores and hyphens.
ALIASES = {
    "Li_icpms": ["LI(PPM)", "LI", "Li_icpms"], "Longitude": ["LONGITUDE", "Longitude (X)", "LON"], "Latitude": ["LATITUDE", "Latitude (Y)", "LAT"],
    "Longitude_min": ["LONGITUDE MIN"], "Longitude_max": ["LONGITUDE MAX"], "Latitude_min": ["LATITUDE MIN"], "Latitude_max": ["LATITUDE MAX"],
    "sample_name": ["SAMPLE NAME", "Sample"], "material": ["TYPE OF MATERIAL", "MATERIAL"], "citation": ["CITATIONS", "CITATION"], "FeOT": ["FEOT(WT%)"], "Fe2O3": ["FE2O3T(WT%)", "FE2O3(WT%)"],
    "SiO2": ["SIO2(WT%)"], "TiO2": ["TIO2(WT%)"], "Al2O3": ["AL2O3(WT%)"], "MnO": ["MNO(WT%)"], "MgO": ["MGO(WT%)"], "CaO": ["CAO(WT%)"], "Na2O": ["NA2O(WT%)"], "K2O": ["K2O(WT%)"], "P2O5": ["P2O5(WT%)"],
}
ALIASES |= {f"{e}_icpms": [f"{e.upper()}(PPM)", e.upper()] for e in ("Th", "U", "Rb", "Cs", "Nb", "Ta", "Pb", "Ba", "Sr", "Zr", "V", "Hf")}


def header_key(name: str) -> str:
    return re.sub(r"[\s_\-]", "", name.replace("\u00a0", " ")).upper()


def column_map(columns: list[str]) -> dict[str, str]:
    """canonical name -> the first column that is one of its aliases."""
    by_key: dict[str, str] = {}
    for c in columns:
        by_key.setdefault(header_key(c), c)
    return {k: by_key[header_key(a)] for k, aliases in ALIASES.items() for a in aliases[::-1] if header_key(a) in by_key}


def missing_core(columns: list[str]) -> list[str]:
    """Which of target, longitude and latitude a file lacks."""
    m = column_map(columns)
    return [k for k, ok in (("Li_icpms", "Li_icpms" in m), ("Longitude", "Longitude" in m or "Longitude_min" in m), ("Latitude", "Latitude" in m or "Latitude_min" in m)) if not ok]


#: What bytes 0x80 to 0x9F mean in cp1252, as which exports that aren't UTF-8 are read; as ISO-8859-1 they are control characters.
_CP1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, header) by file: UTF-8 where all lines are, else ISO-8859-1, the one-byte charset that Spark reads; the first
    line. Files are read line by line, so none has to fit into a task; an empty file has no row."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    good = F.bool_and(F.call_function("is_valid_utf8", F.col("value")))
    return lines.groupBy("path").agg(F.when(good, "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.min_by("value", F.struct("at", "n")).alias("header"))


def encodings(spark: SparkSession, path: str) -> DataFrame:
    return layouts(spark, path).select("path", "encoding")


def header_names(header: str, sep: str = ",") -> list[str]:
    return next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep))


def read_exports(spark: SparkSession, path: str, sep: str = ",", named=None, multi_line: bool = True) -> DataFrame:
    """All CSV files under path as strings with source_file, each in its own encoding, canonical names where a header is known,
    columns of all files; a file without target or coordinates is left out. Files of one header and encoding are one read, whatever
    their number; only names and headers come to the driver. multi_line: quoted values may hold line breaks, so files aren't split.
    named: canonical name -> column, from a header."""
    frames = []
    for r in layouts(spark, path).groupBy("encoding", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("encoding", "header").collect():
        columns = header_names(r.header, sep)
        if missing_core(columns):
            continue
        schema = ", ".join(f"`{c}` string" for c in columns)
        df = spark.read.csv(r.paths, schema=schema, header=True, sep=sep, encoding=r.encoding, multiLine=multi_line, enforceSchema=True)
        by = {v: k for k, v in (named or column_map)(columns).items()}
        fixed = (lambda c: F.translate(f"`{c}`", "".join(_CP1252), "".join(_CP1252.values()))) if r.encoding != "UTF-8" else lambda c: F.col(f"`{c}`")
        frames.append(df.select(*(fixed(c).alias(by.get(c, c)) for c in columns), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")))
    if not frames:
        raise ValueError(f"no file under {path} has a target and coordinates")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_alias(columns: list[str], aliases: list[str]) -> str | None:
    """The column that is the first alias to exist, whatever case and blanks around it."""
    by = {c.strip().lower(): c for c in columns[::-1]}
    return next((by[a.strip().lower()] for a in aliases if a.strip().lower() in by), None)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    # a digest needs its file in one task, which may have 2 GB at most
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def set_digest(files: DataFrame) -> DataFrame:
    """One row: a digest of names and contents, whatever their order. files: (path, sha256), a row per file. Digests of 4096
    shares of the files come first, so no row holds all names."""
    line = F.concat_ws("|", "path", F.coalesce("sha256", F.lit("MISSING")))
    digest = lambda x: F.sha2(F.array_join(F.sort_array(F.collect_list(x)), "\n"), 256).alias("digest")
    shares = files.select(line.alias("line"), F.substring(F.md5(line), 1, 3).alias("share")).groupBy("share").agg(digest(F.col("line")))
    return shares.agg(digest(F.concat_ws("|", "share", "digest")))


def run_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """run.json files as rows, with release_candidate: finished and without a failed algorithm."""
    runs = spark.read.schema("run_id string, model_group string, status string, finished string, failed array<string>").json(path, multiLine=multi_line)
    return runs.withColumn("release_candidate", (F.col("status") == "completed") & (F.coalesce(F.size("failed"), F.lit(0)) <= 0))


def latest(runs: DataFrame, group: str) -> DataFrame:
    return runs.where("release_candidate").groupBy(group).agg(F.max_by("run_id", "finished").alias("run_id"))


def bibliography(df: DataFrame, text: str) -> DataFrame:
    """(id, citation) of lines like "[12] Smith 1999 ..."."""
    at = r"(?s)^\[(\d+)\]\s*(.*)$"
    return df.where(F.col(text).rlike(at)).select(F.regexp_extract(text, at, 1).alias("id"), F.trim(F.regexp_extract(text, at, 2)).alias("citation"))


def quarantine(df: DataFrame, ok, good: str, bad: str) -> None:
    """Rows that pass to one Parquet sink, the others to another."""
    df.where(ok).write.mode("overwrite").parquet(good)
    df.where(~F.coalesce(ok, F.lit(False))).write.mode("overwrite").parquet(bad)


def cached_by_signature(df: DataFrame, signature: str, path: str) -> DataFrame:
    """The features stored under a signature; computed and stored if there are none. A partition is read alone."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        return spark.read.parquet(f"{path}/signature={signature}")
    except AnalysisException:
        df.write.mode("overwrite").parquet(f"{path}/signature={signature}")
        return spark.read.parquet(f"{path}/signature={signature}")


def latest_compatible(runs: DataFrame, signature: str, state: str, order: str) -> DataFrame:
    """Of each signature, the newest run in one of the states "completed" and "resumable"."""
    return runs.where(F.col(state).isin("completed", "resumable")).groupBy(signature).agg(F.max_by("run_id", F.struct(order, "run_id")).alias("run_id"))


def scenes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A row per band of each scene file: cloud and nodata share, the band's scale and offset. complete: nothing of this is missing."""
    schema = "id string, properties struct<`eo:cloud_cover`: double, `s2:nodata_pixel_percentage`: double>, assets map<string, struct<`raster:bands`: array<struct<scale: double, offset: double>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=multi_line)
    one = raw.select(F.col("id").alias("scene_id"), F.col("properties.`eo:cloud_cover`").alias("cloud"), F.col("properties.`s2:nodata_pixel_percentage`").alias("nodata"), F.explode_outer("assets").alias("band", "asset"))
    band = F.get(F.col("asset.`raster:bands`"), F.lit(0))
    out = one.select("scene_id", "cloud", "nodata", "band", band["scale"].alias("scale"), band["offset"].alias("offset"))
    return out.withColumn("complete", F.col("cloud").isNotNull() & F.col("nodata").isNotNull() & F.col("band").isNotNull() & F.col("scale").isNotNull() & F.col("offset").isNotNull())


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1), r"\.[^.]*$", "")


def match_files(samples: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Samples with the path of the file whose stem is their key; samples and files without a partner drop out. files: (path)."""
    return samples.join(files.select("path", stem(F.col("path")).alias(key)), key)


def evidence_pool(tables: DataFrame, features: DataFrame) -> DataFrame:
    """One review schema from a table export (id, material, li) and a feature export (features: array of attribute structs).
    admission: an id that both sources have is "duplicate", no value "no_value", else "admitted"."""
    flat = features.select(F.explode("features").alias("f")).select(F.col("f.attributes.id").alias("id"), F.col("f.attributes.material").alias("material"), F.col("f.attributes.li").alias("li"))
    pool = tables.select("id", "material", "li").withColumn("origin", F.lit("table")).unionByName(flat.withColumn("origin", F.lit("feature")))
    twice = pool.groupBy("id").agg(F.countDistinct("origin").alias("origins"))
    rows = pool.join(twice, "id")
    return rows.withColumn("admission", F.when(F.col("origins") > 1, "duplicate").when(F.col("li").isNull(), "no_value").otherwise("admitted")).drop("origins")


def write_predictions(scored: DataFrame, key: str, score: str, path: str) -> DataFrame:
    """Write the predictions; one row about them: rows, scored ones, mean and range, and a digest of what went in, whatever its order."""
    scored.write.mode("overwrite").parquet(path)
    back = scored.sparkSession.read.parquet(path)
    digest = F.sha2(F.sum(F.xxhash64(key, score).cast("decimal(38,0)")).cast("string"), 256)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"), digest.alias("digest"))
