"""What the operators of this package share: words, tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a regex class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = f"[^{SPACE_CLASS}]+"
SPACES = f"[{SPACE_CLASS}]+"

_local_scratch: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a single-JVM session (tests) may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="veinwork-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of this application, which may be deleted as a whole when it has ended."""
    return f"{shared_dir(spark)}/veinwork-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df once as Parquet (with these options) in the shared folder and read it from there: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1) -> Iterator[None]:
    """What runs meanwhile passes so many rows to Python and reads so many from Parquet at once: where rows are long, a file's thousands of
    rows would be one batch."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key in keys:
            spark.conf.set(key, before[key])


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df (a settled table of short rows) with the hint to broadcast it, if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_shared(rows: DataFrame, shared: DataFrame, on: list[str]) -> DataFrame:
    """rows (inner) joined with shared, a settled table with a row per key and n, the number of rows that have it. Keys that a
    partition's share of all rows or more have can't be more than there are partitions: these are broadcast, the others joined as usual."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = shared.agg(F.sum("n"), F.max("n")).first()
    if not total or most * parts < total:
        return rows.join(shared, on)
    often = F.col("n") * parts >= total
    return rows.join(F.broadcast(shared.where(often)), on).unionByName(rows.join(F.broadcast(shared.where(often).select(on)), on, "left_anti").join(shared.where(~often), on))


def word_array(text: Column) -> Column:
    """Words of a non-null text, in order; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
