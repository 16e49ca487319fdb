"""The folder that driver and executors share, for tables that several steps read and files that a job makes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir of the session; only a single-JVM session may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="veinwork-"))
    return f"{found.rstrip('/')}/veinwork-{app}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet and read from there, so that later steps neither make it again nor lose it with an executor."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
