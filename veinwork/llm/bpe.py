"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list of tokens. Each adjacent pair whose joined bytes are in the vocabulary waits in the
bucket of that rank; bitmaps of 64-bit words, a level above another, mark the buckets that hold something, so the next
rank is a find-first-set per level, whatever the length of the pre-token. An entry whose pair has changed since is stale
and skipped. Within a bucket the leftmost entry comes first, as merges are defined. Pre-tokens seen before are looked
up in a memo of bounded size; it changes no result.

encode() and decode() pass over the rows once, without a shuffle, in any number of tasks; the vocabulary (of a bounded size,
its file) travels as a broadcast. Ids are little-endian unsigned 32-bit integers in one binary value, the form in which token
files are kept.

Cases: null and empty texts have no tokens and decode to no bytes; repeated rows stay; columns that aren't kept are
ignored, whatever their names; empty tables give empty ones. Very long texts are cut into stretches where a pre-token
begins, whatever comes before; a very long pre-token costs memory and time in proportion to its length (times the bits of it).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MEMO = 1 << 19  # pre-tokens; a full memo is emptied
MEMO_CHARS = 128  # longer pre-tokens are encoded each time
STRETCH = 1 << 20  # characters of a text split at once
BATCH_BYTES = 4 << 20
WIDTH = 8  # bits of a rank that one word of the lower level tells apart
_MASK = (1 << WIDTH) - 1
_BIT = [1 << i for i in range(1 << WIDTH)]


class Vocabulary:
    """Ranks of byte strings: every single byte, and the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"ranks lack the single bytes {missing}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((max(self.bytes_of) >> WIDTH) + 1)
        self.split = splitter()
        self.memo = _Memo(self)

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. The queue: positions in buckets by rank; a bit of a word in `low` marks a bucket that holds something,
        a bit of `top` a word that isn't 0. It is written out here, as this is where the time goes."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get, n, buckets, low, top, bit = ranks.get, len(piece), self.buckets, self.low, 0, _BIT
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        waits.append(-1)
        for i, rank in enumerate(waits):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, so a heap
                else:
                    buckets[rank] = [i]
                    at = rank >> WIDTH
                    if not low[at]:
                        top |= 1 << at
                    low[at] |= bit[rank & _MASK]
        while top:
            at = (top & -top).bit_length() - 1
            word = low[at]
            rank = at << WIDTH | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[at] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waits[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            waits[i] = waits[j] = -1
            if k < n:
                before[k] = i
                new = get(piece[i : after[k]])
                if new is not None:
                    waits[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        at = new >> WIDTH
                        if not low[at]:
                            top |= 1 << at
                        low[at] |= bit[new & _MASK]
            i = before[i]
            if i >= 0:
                new = waits[i] = get(piece[i:k], -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        at = new >> WIDTH
                        if not low[at]:
                            top |= 1 << at
                        low[at] |= bit[new & _MASK]
        ids, i = [], 0
        while i < n:
            k = after[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text, 4 bytes each."""
        memo, out = self.memo, []
        for stretch in stretches(text):
            out.append(b"".join(map(memo.__getitem__, self.split(stretch))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        if len(ids) % 4:
            raise ValueError(f"{len(ids)} bytes aren't ids of 4 bytes each")
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary):
        self.merged = vocabulary.merged

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merged(word.encode())).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut before a space after a visible ASCII character: a pre-token begins there."""
    at = 0
    while len(text) - at > STRETCH:
        cut = _CUT.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_CUT = regex.compile(r"(?<=[!-~]) ")


class Splitter:
    """The published pattern of public_tokenizers, with letters and numbers as the tokenizer library's Unicode version has them: the
    regex module's is newer and has more. Texts without such characters go by the plain pattern, which is quicker."""

    def __init__(self):
        import public_tokenizers
        import tiktoken

        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([i]): i for i in range(256)}
        pattern = public_tokenizers.PATTERN
        self.plain, less, lowest = regex.compile(pattern), "", 0x110000
        for kind in (r"\p{L}", r"\p{N}"):
            known = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
            newer = sorted(set(map(ord, regex.findall(kind, points))) - set(map(ord, bytes(known).decode())))
            if newer:
                first, last = [p for p, q in zip(newer, [-2, *newer]) if p != q + 1], [p for p, q in zip(newer, [*newer[1:], -2]) if p + 1 != q]
                runs = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))
                pattern, less, lowest = pattern.replace(kind, f"[{kind}--[{runs}]]"), less + runs, min(lowest, newer[0])
        self.exact = regex.compile(pattern, regex.V1)
        self.beyond = regex.compile(f"[\\U{lowest:08x}-\\U0010ffff]") if less else None
        self.newer = regex.compile(f"[{less}]") if less else None

    def __call__(self, text: str) -> list[str]:
        odd = not text.isascii() and self.beyond is not None and self.beyond.search(text) and self.newer.search(text)
        return (self.exact if odd else self.plain).findall(text)


@lru_cache(1)
def splitter() -> Splitter:
    return Splitter()


@lru_cache(2)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return _vocabulary(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _sent(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns, n_tokens and ids of every whole text, by the rank file at path (the driver's; tasks get its bytes)."""
    sent, n = _sent(docs.sparkSession, path), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(sent.value)
        for b in batches:
            for part in parts(b, n):
                ids = [words.encode(t) if t else b"" for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    slim = docs.select(*[F.col(c) for c in keep], (F.col(text) if isinstance(text, str) else text).alias("__text"))
    return slim.mapInArrow(run, _schema(slim, keep) + ", n_tokens bigint, ids binary")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with decoded, the bytes of their ids (null ids: null); an id that isn't in the vocabulary is an error."""
    names, sent = rows.columns, _sent(rows.sparkSession, path)
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(sent.value)
        for b in batches:
            for part in parts(b, at):
                out = [None if x is None else words.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return rows.mapInArrow(run, _schema(rows, tuple(names)) + ", decoded binary")


def _schema(rows: DataFrame, names: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def parts(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about so many bytes of that column."""
    begin = size = 0
    for i, n in enumerate(_lengths(batch.column(column))):
        size += n
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _lengths(values: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_pylist()


def op12_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    rows = decode(encode(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
