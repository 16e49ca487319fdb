"""From raw documents to sharded training data: STAGES in order, each written as Parquet and read again.

quality rules -> near-duplicate removal -> benchmark decontamination -> mixing to target weights -> sharding.
All stages but the last return the columns of documents; the last adds shard and slot.

Cases, stage by stage: null and empty texts fail the base rules of the first stage and go; rows of null or equal ids are judged each by its own
text; of repeated rows (equal id and text) one stays, chosen by a hash of all columns; ties go by hashes, so reruns agree; very long
texts are read whole; extra columns, whatever their names, pass through to the end; an empty table gives an empty one, and without labels or
benchmark items the stages that use them keep all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinwork.llm import decontam, jaccard, mixing, quality, sharding
from veinwork.llm.common import read_table, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=5, num=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.spread(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: Binomial tails, shingle hashes and the ring's hashes aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
