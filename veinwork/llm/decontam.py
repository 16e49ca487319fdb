"""Benchmark decontamination by spaced-seed hashing.

Texts become words (lower-cased, punctuation around them dropped). A mask looks at some words of a span and ignores the
rest, so a hit survives substitutions at ignored positions. What counts as contamination, along a diagonal of a document
and an item: a stretch of MIN_RUN words or more, equal at both ends, of which MIN_SHARE are equal; or the whole item, from
SHORTEST words on, of which MIN_SHARE are equal. The fixed MASKS cover this for items of SPAN words or more: each way to
substitute a quarter of 12 to 23 words leaves some mask whole at some place (the tests enumerate all), and a longer stretch is
cut into parts of 12 to 23 words, one of which has no larger share of substitutions. Shorter items have masks for their
length: it is cut into two parts more than may be substituted, and every two parts make a mask. Items of fewer than SHORTEST words
occur everywhere; they count where a document is exactly the item, word for word, for which one mask looks at all words.

1. Items become seeds, (hash, item, places). A bitmap of the hashes' top bits, at most 2 ** MOST_BITS of them, goes to all tasks.
2. One pass over the documents hashes every position under every mask; those that the bitmap lets through leave as
   (document, hash, places) and are joined with the seeds. A hit names an item and a diagonal.
3. Documents with hits are read again; the words around each group of neighbouring diagonals are joined with the
   item's words and compared along every diagonal.

Only texts of documents with hits are shuffled, to meet their hits; all texts are if there are more than FEW_KEYS such documents and too
many for Spark to broadcast their keys. Hits are never broadcast: Parquet keeps what documents share once, so its size, by which Spark
chooses, says little of theirs. A hash that many documents share is a skewed key of the join with the seeds, which adaptive execution splits.

Cases: null or blank texts match nothing; rows of equal id and text are found once; null ids are rows like any other, of
documents and of items; items of equal id and text count once, without words never;
very long texts are hashed whole, a few hundred thousand words at once;
an empty table on either side finds nothing; extra columns are ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, read_table, small, staged
from .jaccard import ROWS, Words, mix

SPAN = 12
#: The looked-at positions of each mask, from 0 to less than SPAN; found by search over all patterns.
MASKS = (
    (0, 1, 2, 4, 7),
    (0, 1, 3, 4, 5),
    (0, 3, 7, 8, 9),
    (0, 1, 5, 7, 10),
)
MIN_RUN, MIN_SHARE, SHORTEST = 12, 0.75, 6
MOST_BITS = 27
#: Words hashed at once, and comparisons made at once, in a task.
AT_ONCE = 400_000
#: So many keys of documents with hits are broadcast, whatever Spark's limit: less than 100 bytes each in memory.
FEW_KEYS = 500_000
_EDGE = "\"'`.,;:!?()[]{}<>*_#|~-–—‘’“”«»…¡¿"
_MULT = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

FOUND = "doc_id bigint, item_id bigint, doc_word bigint, run_words bigint, equal_words bigint, item_words bigint"


class Cores(Words):
    """Hashes of words without punctuation around them; 0 for what has nothing else."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE)
        h = super().__missing__(core.encode()) if core else 0
        self[word] = h
        return h


def tokens(text: str, cores: Cores) -> np.ndarray:
    w = text.lower().split()
    ids = np.fromiter(map(cores.__getitem__, w), np.uint64, len(w))
    return ids[ids != 0]


def masks_for(n: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(number, span, looked-at positions) of the masks of an item of n words."""
    if n >= SPAN:
        return [(m, mask[-1] + 1, mask) for m, mask in enumerate(MASKS)]
    if n < SHORTEST:
        return [(100 * n, n, tuple(range(n)))] if n else []
    cut = math.floor(n * (1 - MIN_SHARE)) + 2
    parts = [range(n * i // cut, n * (i + 1) // cut) for i in range(cut)]
    return [(100 * n + j, n, (*a, *b)) for j, (a, b) in enumerate(combinations(parts, 2))]


def seeds(ids: np.ndarray, number: int, span: int, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position that has its whole span."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(number + 1), np.uint64)
    for j, p in enumerate(mask):
        h += ids[p : p + n] * _MULT[j]
    return mix(h)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


ITEMS, SEEDS, HITS = "item bigint, n int, words binary", "hash bigint, item bigint, n int, at binary", "key bigint, hash bigint, pos binary"
DIAGONALS, CUTS = "key bigint, item bigint, n int, diagonals binary", "key bigint, doc_id bigint, item bigint, base bigint, near binary, diagonals binary"


def _runs(h: np.ndarray, *others: np.ndarray) -> Iterator[tuple]:
    """Each distinct value of h with the slices of the others that belong to it."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, others = h[order], [x[order] for x in others]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])).tolist()
    for a, b in zip(cut, [*cut[1:], len(h)], strict=True):
        yield h[a], *(x[a:b] for x in others)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cores = Cores()
    for b in batches:
        words = [tokens(t.as_py(), cores) for t in b.column(1)]
        yield _batch([b.column(0), [len(w) for w in words], [w.tobytes() for w in words]], ITEMS)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, n, words in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            w, rows = np.frombuffer(words, np.uint64), []
            for number, span, mask in masks_for(n):
                h = seeds(w, number, span, mask)
                rows += [(int(x.view(np.int64)), item, n, at.astype(np.int32).tobytes()) for x, at in _runs(h, np.arange(len(h)))]
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 4, SEEDS)


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the hashes' top bits, in bytes."""
    top = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), top.bitwiseAND(F.lit(63)).cast("int"))
    got = rows.groupBy(F.shiftright(top, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** (bits - 6)
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def _hits(masks: list, bitmap, bits: int):
    shift, low, eight = np.uint64(64 - bits), np.uint64(7), np.uint64(3)

    def found(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        n = np.array([len(w) for _, w in held])
        ids = np.concatenate([w for _, w in held])
        owner = np.repeat(np.arange(len(held)), n)
        start = np.cumsum(n) - n
        left = (start + n)[owner] - np.arange(len(ids))
        keys = np.array([k for k, _ in held], np.int64)
        rows: tuple[list, list, list] = ([], [], [])
        for number, span, mask in masks:
            h = seeds(ids, number, span, mask)
            top = h >> shift
            pos = np.flatnonzero((bitmap.value[top >> eight] >> (top & low).astype(np.uint8)) & 1 & ((left[: len(h)] >= span) if span >= SHORTEST else (n[owner][: len(h)] == span)))
            for o, p, x in _runs(owner[pos], pos - start[owner[pos]], h[pos]):
                for value, where in _runs(x, p):
                    rows[0].append(int(keys[o]))
                    rows[1].append(int(value.view(np.int64)))
                    rows[2].append(where.astype(np.int32).tobytes())
        return _batch(list(rows), HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, held, size = Cores(), [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = tokens(text.as_py(), cores)
                if len(w):
                    held.append((key, w))
                    size += len(w)
                if size > AT_ONCE:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)

    return run


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From places in the document and in the item: a diagonal is where in the document the item's first word would be."""
    for b in batches:
        out = []
        for p, a in zip(b.column(3), b.column(4), strict=True):
            p, a = np.frombuffer(p.as_buffer(), np.int32).astype(np.int64), np.frombuffer(a.as_buffer(), np.int32)
            some = [np.unique(np.subtract.outer(p[i : i + AT_ONCE // len(a) + 1], a)) for i in range(0, len(p), AT_ONCE // len(a) + 1)]
            out.append((some[0] if len(some) == 1 else np.unique(np.concatenate(some))).tobytes())
        yield _batch([b.column(0), b.column(1), b.column(2), out], DIAGONALS)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each group of neighbouring diagonals of a document and an item."""
    cores = Cores()
    for b in batches:
        for key, doc, text, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            w, rows = tokens(text.as_py(), cores), []
            by: dict[int, list] = {}
            for h in hits:
                by.setdefault(h["item"], [h["n"]]).append(np.frombuffer(h["diagonals"], np.int64))
            for item, (n, *some) in by.items():
                d = np.unique(np.concatenate(some))
                for group in np.split(d, np.flatnonzero(np.diff(d) > n) + 1):
                    lo, hi = max(0, int(group[0])), int(group[-1]) + n
                    rows.append((key, doc, item, lo, w[lo:hi].tobytes(), group.tobytes()))
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 6, CUTS)


def stretch(same: np.ndarray, least: int) -> tuple[int, int, int]:
    """(length, equal words, start) of the longest stretch of at least `least` words of which MIN_SHARE are equal,
    both ends equal (of equally long ones that with most equal words, then the first); zeros if there is none."""
    at = np.flatnonzero(same)
    if len(at) < MIN_SHARE * least:
        return 0, 0, 0
    # over prefix sums of (equal - share), the farthest end not below each start
    balance = np.concatenate([[0.0], np.cumsum(same - MIN_SHARE)])
    top = np.maximum.accumulate(balance[::-1])[::-1]
    end = np.searchsorted(-top, -balance[at] + 1e-9, "right") - 1
    end = at[np.searchsorted(at, end) - 1] + 1
    count = np.concatenate([[0], np.cumsum(same)])
    equal = count[end] - count[at]
    best = int(np.lexsort((-at, equal, end - at))[-1])
    s, e = int(at[best]), int(end[best])
    return (e - s, int(equal[best]), s) if e - s >= least else (0, 0, 0)


def contaminated(same: np.ndarray, inside: bool) -> tuple[int, int, int]:
    """(length, equal words, start) of what counts along a diagonal, zeros if nothing does. inside: the document holds the whole diagonal."""
    n = len(same)
    if inside and (equal := int(same.sum())) >= (MIN_SHARE if n >= SHORTEST else 1) * n:
        return n, equal, 0
    return stretch(same, MIN_RUN)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From words of a document from word base on, diagonals and an item's words: FOUND with key and item."""
    for b in batches:
        rows = []
        for key, doc, item, base, near, diagonals, item_id, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            near, diagonals, w = (np.frombuffer(x, k) for x, k in ((near, np.uint64), (diagonals, np.int64), (words, np.uint64)))
            n, best = len(w), (0, 0, 0)
            for i in range(0, len(diagonals), AT_ONCE // n + 1):
                d = diagonals[i : i + AT_ONCE // n + 1]
                at = (d - base)[:, None] + np.arange(n)
                held = (at >= 0) & (at < len(near))
                same = held & (near[np.clip(at, 0, len(near) - 1)] == w)
                for j in np.flatnonzero(same.sum(1) >= MIN_SHARE * min(MIN_RUN, n)):
                    run, equal, start = contaminated(same[j], bool(held[j].all()))
                    if run:
                        best = max(best, (run, equal, -int(d[j] + start)))
            if best[0]:
                rows.append((key, item, doc, item_id, -best[2], best[0], best[1], n))
        yield _batch(list(zip(*rows, strict=True)) or [[]] * 8, "key bigint, item bigint, " + FOUND)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """FOUND: a row for each document and item with contamination, the longest stretch of it."""
    spark = docs.sparkSession
    keyed = lambda df, i, t: df.select(F.col(i).cast("bigint").alias("id"), F.coalesce(F.col(t), F.lit("")).alias("text")).select(F.xxhash64(F.col("id").isNull(), "id", "text").alias("key"), "id", "text")
    named = keyed(benchmark, item_col, item_text).dropDuplicates(["key"])
    texts = named.select("key", "text").mapInArrow(_item_words, ITEMS).where("n > 0")
    items = staged(texts.join(named.select(F.col("key").alias("item"), F.col("id").alias("item_id")), "item"), "decontam-items")
    marks = staged(items.select("item", "n", "words").mapInArrow(_item_seeds, SEEDS), "decontam-seeds")
    if not (n := marks.count()):
        return spark.createDataFrame([], FOUND)
    lengths = [r.n for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]  # at most SPAN
    bits = max(16, min(MOST_BITS, n.bit_length() + 6))
    bitmap = spark.sparkContext.broadcast(_bitmap(marks, bits))

    rows = keyed(docs, id_col, text_col)
    hits = rows.select("key", "text").mapInArrow(_hits([m for k in sorted(lengths) for m in masks_for(k)], bitmap, bits), HITS)
    met = hits.join(marks, "hash").select("key", "item", "n", "pos", "at").mapInArrow(_diagonals, DIAGONALS)
    met = staged(met.groupBy("key").agg(F.collect_set(F.struct("item", "n", "diagonals")).alias("hits")), "decontam-hits")
    keys = small(staged(met.select("key"), "decontam-keys"), FEW_KEYS)
    held = rows.join(keys, "key", "left_semi").join(met.hint("merge"), "key")
    cuts = held.select("key", F.col("id").alias("doc_id"), "text", "hits").mapInArrow(_cuts, CUTS)
    both = cuts.join(items, "item").select("key", "doc_id", "item", "base", "near", "diagonals", "item_id", "words")
    found = both.mapInArrow(_verified, "key bigint, item bigint, " + FOUND)
    best = F.max(F.struct("run_words", "equal_words", (-F.col("doc_word")).alias("first"))).alias("best")
    one = found.groupBy("key", "item").agg(best, *(F.first(c).alias(c) for c in ("doc_id", "item_id", "item_words")))
    return one.select("doc_id", "item_id", (-F.col("best.first")).alias("doc_word"), "best.run_words", "best.equal_words", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without contamination, with their own columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__vw_key", F.xxhash64(F.col(id_col), text))
    with few_rows(docs.sparkSession, ROWS):
        hit = overlaps(keyed.select("__vw_key", F.col(text_col).alias("__vw_text")), benchmark, "__vw_key", "__vw_text")
        hit = staged(hit.select(F.col("doc_id").alias("__vw_hit")).distinct(), "decontam")
    return keyed.join(hit, F.col("__vw_key") == F.col("__vw_hit"), "left_anti").drop("__vw_key")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
