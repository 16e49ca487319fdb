"""Delta-maintained token rollups.

A store is a folder of committed batches. A batch holds signed ledger rows, (doc_id, source, lang, tokenizer, docs,
tokens): what a change takes back counts negative, what it puts in its place positive. Totals by source, language and
tokenizer version are sums of the batches' small delta tables; recounting never happens.

The ledger is laid out in BUCKETS folders by hash of the id, so that a batch reads the former counts of the buckets that it
touches alone; a change of few documents reads few of them, one that touches all buckets reads the ledger once. compact() sums up
all committed batches in one, so that files don't grow in number without end and a document's former counts are one row.

apply() commits once: a batch writes its ledger and its deltas under its own id, then its marker; readers take marked
batches alone. A batch that was committed before is left alone, one that broke off is written anew, so a batch can be
sent again at any time, after compact() too (its marker names the batches that it covers). One writer at a time.

Changes: (op, doc_id, source, lang, tokenizer, tokens). "put" inserts a document or revises it (its former counts under
the same tokenizer version are taken back, wherever they stood), "delete" takes it back. Rows of one id and tokenizer
within a batch are all put; a delete in the same batch as puts of that id takes back only the former counts.

Cases: null text has 0 tokens; null source or language is a group of its own; a null id can be put, but no later change
reaches it; deletes of unknown ids change nothing; an empty batch commits; extra columns are ignored. The query deletes
copies of a text that has a smaller id; null texts are no copies of each other, rows of a null id aren't deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_shared, read_table, scratch_path, staged

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

LEDGER = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
DELTAS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
GROUP = ["source", "lang", "tokenizer"]
BUCKETS = 64


@lru_cache(2)
def encoding(folder: str, vocabulary: str):
    import base64

    import tiktoken

    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
            folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, source string, lang string, tokens bigint").select("doc_id", "source", "lang", F.lit(vocabulary).alias("tokenizer"), "tokens")


class Store:
    """Committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def markers(self) -> dict[str, list[str]]:
        """Committed batches and, of compacted ones, the batches they cover."""
        try:
            rows = self.spark.read.schema("batch string, covers array<string>").json(f"{self.folder}/commits/*").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r.batch: r.covers or [] for r in rows}

    def committed(self) -> list[str]:
        return sorted(self.markers())

    def _read(self, what: str, schema: str) -> DataFrame:
        marked = self.markers()
        covered = {b for some in marked.values() for b in some}
        paths = [f"{self.folder}/{what}/{b}" for b in sorted(marked) if b not in covered]
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER + ", bucket int")

    def current(self) -> DataFrame:
        """What every document counts now."""
        return _summed(self.ledger(), ["bucket", "doc_id", *GROUP]).drop("bucket")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens: the sums of all committed deltas."""
        return _summed(self._read("deltas", DELTAS), GROUP)

    def _commit(self, batch: str, rows: DataFrame, covers: list[str]) -> None:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        # about as many files as partitions, whatever the number of tasks that made the rows
        shares = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        share = F.pmod(F.xxhash64("doc_id", "source", "lang", "tokens"), F.lit(shares))
        rows.withColumn("bucket", bucket).repartition("bucket", share).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER + ", bucket int").parquet(f"{self.folder}/ledger/{batch}")
        _summed(written, GROUP).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        self.spark.createDataFrame([(batch, covers)], "batch string, covers array<string>").coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/{batch}")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the batch; False if it was committed before. batch: letters, digits, hyphens."""
        if not batch or not all(c.isalnum() or c == "-" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.markers():
            return False
        changes = staged(changes.select("op", F.col("doc_id").cast("bigint").alias("doc_id"), *GROUP, "tokens"), "rollup-changes")
        ids = changes.where("doc_id is not null")
        touched = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()  # BUCKETS at most
        ids = ids.select("doc_id", F.col("tokenizer").alias("__t")).distinct()
        former = self.ledger().where(F.col("bucket").isin([r.bucket for r in touched])).drop("bucket")
        former = _summed(former.join(ids, "doc_id").where("tokenizer <=> __t"), ["doc_id", *GROUP])
        back = former.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        put = changes.where("op = 'put'").select("doc_id", *GROUP, F.lit(1).cast("bigint").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
        self._commit(batch, put.unionByName(back), [])
        return True

    def compact(self, batch: str) -> None:
        """Sum up all committed batches in this one. The former files may be deleted by folder afterwards; their markers stay."""
        covers = self.committed()
        if batch not in covers:
            self._commit(batch, self.current(), covers)


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of a corpus in three batches: all documents are counted; those whose white space a cleaner changes are
    counted again; copies of a text with a smaller id are deleted. The second batch is sent twice."""
    docs = read_table(spark, sf_dir, "documents")
    store = Store(spark, scratch_path(spark, "rollups"))
    put = F.lit("put").alias("op")
    store.apply("1-first-count", counted(docs).select(put, "*"))
    cleaned = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    revised = counted(docs.withColumn("__clean", cleaned).where("__clean <> text").select("doc_id", "source", "lang", F.col("__clean").alias("text")))
    store.apply("2-white-space", revised.select(put, "*"))
    keys = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("k1"), F.md5("text").alias("k2"))
    first = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = join_shared(keys, staged(first, "rollup-first"), ["k1", "k2"]).where("doc_id > first")
    store.apply("3-copies", copies.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit(VOCABULARY).alias("tokenizer"), F.lit(0).cast("bigint").alias("tokens")))
    store.apply("2-white-space", revised.select(put, "*"))
    return store.totals()
