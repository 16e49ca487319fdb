"""Incremental ingest with Structured Streaming: bounded batches, resume by checkpoint, dedupe, running counters."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, transform, target: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Take all new files under source through transform into Parquet, then stop; what was done before isn't done again."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("header", "true").csv(source)
    return transform(raw).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """The first row of a key within the watermark; state is dropped behind it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def upsert(target: str, keys: list[str], order: str, buckets: int = 64):
    """A foreachBatch function: of all rows of a key, the one highest in order stays (upserted() reads them). Keys lie in buckets by
    hash, null ones alike; a batch writes the buckets that it touches anew as a version of its own, which is complete once its
    marker is there, so a repeated batch changes nothing and one that broke off is written again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys, *(F.col(k).isNull() for k in keys)), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # buckets at most
        done = versions(spark, target)
        if any(v == number for v, _ in done):
            return
        old = upserted(spark, target, touched)
        rows = new if old is None else old.unionByName(new)
        by = ["bucket", *keys]
        best = rows.groupBy(*by).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in by)), order).alias("row")).select(*by, "row.*")
        best.select(*rows.columns).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        spark.createDataFrame([(number, touched)], "version bigint, buckets array<int>").coalesce(1).write.mode("overwrite").json(f"{target}/markers/{number}")

    return run


def versions(spark: SparkSession, target: str) -> list[tuple[int, list[int]]]:
    """Complete versions and the buckets that they hold."""
    try:
        return sorted((r.version, r.buckets or []) for r in spark.read.schema("version bigint, buckets array<int>").json(f"{target}/markers/*").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def upserted(spark: SparkSession, target: str, only: list[int] | None = None) -> DataFrame | None:
    """The rows of the latest version of each bucket (of those in only, with the bucket column); None if there is none."""
    latest = {b: v for v, buckets in versions(spark, target) for b in buckets if only is None or b in only}
    if not latest:
        return None
    by_version: dict[int, list[int]] = {}
    for b, v in latest.items():
        by_version.setdefault(v, []).append(b)
    frames = [spark.read.parquet(f"{target}/version={v}").where(F.col("bucket").isin(some)) for v, some in sorted(by_version.items())]
    rows = reduce(DataFrame.unionByName, frames)
    return rows if only is not None else rows.drop("bucket")


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """Running counts by status, for update mode."""
    return stream.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pruned(spark: SparkSession, target: str) -> int:
    """Delete what no bucket's latest version holds: folders of versions all of whose buckets were written anew since, and their markers but
    the last (which tells a repeated batch from a new one). Returns how many. For when no batch is being written."""
    marked = versions(spark, target)
    latest = {b: v for v, buckets in marked for b in buckets}
    old = [v for v, _ in marked[:-1] if v not in latest.values()]
    jvm = spark.sparkContext._jvm
    for v in old:
        for path in (f"{target}/version={v}", f"{target}/markers/{v}"):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)


def upserting(spark: SparkSession, source: str, schema: str, event_time: str, keys: list[str], order: str, target: str, checkpoint: str, delay: str = "1 day", files_a_batch: int = 1, buckets: int = 64) -> StreamingQuery:
    """Take the files under source that came since the last run, oldest first, into target (upserted() reads it), then stop: rows sent again within the
    watermark are dropped by state, rows that come later than it are dropped as late, and of what is left the row of a key highest in order stays.
    The checkpoint holds the state, so a stopped query goes on where it was; a batch that is repeated changes nothing."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("latestFirst", "false").parquet(source)
    once = deduplicated(rows, [*keys, order], event_time, delay)
    return once.writeStream.foreachBatch(upsert(target, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
