"""Cross-tokenizer alignment by whitespace-token anchors.

A byte-level BPE (A) and a sentencepiece model (B) encode every text. Where a token of A and one of B end at one byte and the
next token of both begins with a space, the document is cut into windows of token ids. A window's alignment - the groups between shared
ends, and all pairs of overlapping tokens - hangs on its ids alone, so it is kept in a memo by its id tuples; most windows of a
corpus were seen before. New windows are aligned many at once, as arrays. A memo of bounded size changes no result; when it is full, what several
chunks had stays.

A text is tokenised in segments, cut before a single space between visible characters, where that gives the tokens of the whole text:
A's pattern begins a pre-token there, and B's merges can't join a space after another character if no piece has one, which is
looked up in the model (else whole texts are tokenised). Such a cut is an anchor by itself once both sides' token bytes are the
segment's, so a segment's windows are those of the document; what was verified of a segment is remembered with it. A text that
holds a segment whose token bytes aren't the segment's is tokenised as a whole and judged by all its bytes.

pair_counts() counts in how many documents two ids are linked. Each document lies in one task, so tasks count distinct pairs of their
documents and only sums are shuffled. scored() looks the counts up: the FREQUENT most common pairs at most travel as a broadcast; the
rest, each of which few documents have, are joined. So neither a common pair's rows meet in one task nor does what is broadcast grow.

Cases: null and empty texts, and texts whose token bytes differ from space + text, have no tokens: zeros and ''. Rows of
equal or null id stay rows of their own, and count as documents of their own. Very long texts and windows (no spaces) take memory in
proportion to their length. Other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import parts
from .common import few_rows, read_table, staged

SEGMENTS, SEGMENT_CHARS = 80_000, 6 << 20  # what the memo of segments and windows holds before it is cleared
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1 << 10  # documents that go to Python at once
FREQUENT = 1 << 20  # pairs whose counts are broadcast: 17 bytes each
PENDING = 1 << 18  # pairs that a task holds before it sums them up
SPACE = "▁"
#: How chunks are written: a row has megabytes, and Parquet by itself looks at sizes every 100 rows only, so that a file was one page and one row group.
WIDE = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_GAP = b"\xff\xff\xff\xff"
_CUT = re.compile(r"(?<=[^ ])(?= [^\s])")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: ids() of texts that begin with a space, bytes_of each id; apart: whether segments() may be tokenised each by itself."""

    bytes_of: list[bytes]
    apart: bool
    whole = False  # whether any text's tokens have its bytes

    def ready(self) -> None:
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in self.bytes_of])

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        lists = self.ids(texts)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def exact(self, texts: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are the text's, of each text; n: how many tokens it has."""
        size, ends = np.fromiter(map(len, texts), np.int64, len(texts)), np.cumsum(n)
        before = np.concatenate([[0], np.cumsum(self.length[ids])])
        ok = before[ends] - before[ends - n] == size
        own, said = b"".join(compress(texts, ok.tolist())), b"".join(map(self.bytes_of.__getitem__, ids[np.repeat(ok, n)].tolist()))
        if own != said:
            differ = np.concatenate([[0], np.cumsum(np.frombuffer(own, np.uint8) != np.frombuffer(said, np.uint8))])
            ends = np.cumsum(size[ok])
            ok[np.flatnonzero(ok)] = differ[ends] == differ[ends - size[ok]]
        return ok


class ByteLevel(Side):
    def __init__(self, raw: bytes):
        form, kinds = json.loads(raw), _byte_level()
        pre = form["pre_tokenizer"] or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and form["normalizer"] is None
        vocab: dict[str, int] = form["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in form["added_tokens"])]))
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in form["added_tokens"])]:
            self.bytes_of[i] = bytes(map(kinds.__getitem__, token)) if all(c in kinds for c in token) else token.encode()
        self.ready()
        ranks = self.ranks(form["model"]) if self.apart else None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda texts: list(map(self.encoding.encode_ordinary, texts))
            self.whole = True  # every byte is a token, and the pattern takes every character
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.tokenizer = Tokenizer.from_str(raw.decode())
            self.tokenizer.encode_special_tokens = True
            self.ids = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts between which a longer text would be cut are encoded as one: they have the tokens there that each has by itself."""
        if not self.whole:
            return super().tokens(texts)
        blocks: list[str] = []
        for joins, some in groupby(texts, lambda t: len(t) > 1 and not t[1].isspace() and not t[-1].isspace()):
            blocks += ["".join(some)] if joins else some
        ids = np.concatenate([self.encoding.encode_to_numpy(x, disallowed_special=()) for x in blocks])
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1, prepend=0)

    def ranks(self, model: dict) -> dict[bytes, int] | None:
        """The vocabulary as ranks, if it is one: single bytes, then what each merge makes, in the order of merges. The lowest merge first is
        then the lowest rank first; the rank library is several times quicker on short texts and gives the same ids."""
        plain = not model.get("ignore_merges") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        sides = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = (x + y for x, y in sides)
        if not plain or any(model["vocab"].get(t) != 256 + i for i, t in enumerate(made)) or any(len(b) != 1 for b in self.bytes_of[:256]):
            return None
        return {self.bytes_of[i]: i for i in range(256 + len(model["merges"]))}


class Pieces(Side):
    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        # a segment by itself and behind others must be one thing; a model that adds or drops spaces elsewhere fails this
        tried = [[" a", " b", " c\n", " d"], [" c,  e", " a"]]
        self.apart = not inner and all(self.ids(["".join(t)])[0] == [i for ids in self.ids(t) for i in ids] for t in tried)
        self.ready()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)  # the model adds the space


def segments(text: str) -> list[str]:
    return _CUT.split(text)


class Windows:
    """Alignments by id tuples: for window i, its groups as text, their number, the number of A's and B's tokens, and the linked ids."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        names = list(map(str, range(max(len(a.bytes_of), len(b.bytes_of)))))
        self.digits = np.array(names, f"S{len(names[-1])}").view(np.uint8).reshape(len(names), -1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[int, ...] | None] = {}  # windows of a segment; None where token bytes aren't its
        self.again: set[str] = set()  # segments that were known when a later chunk had them
        self.number: dict[bytes, int] = {}  # in the order of numbers
        self.text: list[str] = []
        self.groups: list[int] = []
        self.size_a: list[int] = []
        self.size_b: list[int] = []
        self.links: list[bytes] = []

    def trim(self) -> None:
        """Clears a full memo: what came again stays, if that is at most half of what the memo holds. Numbers change."""
        if len(self.known) < SEGMENTS and sum(map(len, self.known)) <= SEGMENT_CHARS:
            return
        if len(self.again) > SEGMENTS // 2 or sum(map(len, self.again)) > SEGMENT_CHARS // 2:
            self.forget()
            return
        known = {x: self.known[x] for x in self.again}
        used = sorted({n for own in known.values() if own for n in own})
        place, keys = {n: i for i, n in enumerate(used)}, list(self.number)
        kept = [[x[n] for n in used] for x in (self.text, self.groups, self.size_a, self.size_b, self.links)]
        self.known = {x: own and tuple(map(place.__getitem__, own)) for x, own in known.items()}
        self.again, self.number = set(), {keys[n]: i for n, i in place.items()}
        self.text, self.groups, self.size_a, self.size_b, self.links = kept

    def documents(self, texts: list[str | None]) -> list[list[int] | None]:
        """Numbers of each text's windows, in order; None for a text without tokens."""
        apart = self.a.apart and self.b.apart
        cut = [(segments(" " + t) if apart else [" " + t]) if t else None for t in texts]
        distinct = set(chain.from_iterable(filter(None, cut)))
        new = list(distinct.difference(self.known))
        self.again |= distinct.difference(new)
        for k in range(0, len(new), 1 << 14):
            some = new[k : k + (1 << 14)]
            self.known.update(zip(some, self.of(some)))
        out: list[list[int] | None] = []
        odd = []
        for some in cut:
            try:
                out.append(some and list(chain.from_iterable(map(self.known.__getitem__, some))))
            except TypeError:  # a segment's None isn't a tuple
                if apart:
                    odd.append(len(out))
                out.append(None)
        for i, own in zip(odd, self.of([" " + texts[i] for i in odd])):
            out[i] = None if own is None else list(own)
        return out

    def of(self, texts: list[str]) -> list[tuple[int, ...] | None]:
        """Numbers of the windows of each text; None where token bytes aren't its."""
        if not texts:
            return []
        (a, n_a), (b, n_b), said = self.a.tokens(texts), self.b.tokens(texts), [t.encode() for t in texts]
        ok = np.ones(len(texts), bool)
        for side, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            if not side.whole:
                ok &= side.exact(said, ids, n)
        size = np.fromiter(map(len, said), np.int64, len(said))[ok]
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        first = np.cumsum(size) - size
        numbers, begins = self.windows(a, b, first)
        at = np.append(np.searchsorted(begins, first), len(begins))
        of_good = list(zip(map(numbers.__getitem__, at[:-1].tolist())))
        for i in np.flatnonzero(np.diff(at) > 1).tolist():
            of_good[i] = tuple(numbers[at[i] : at[i + 1]])
        if ok.all():
            return of_good
        left = iter(of_good)
        return [next(left) if good else None for good in ok.tolist()]

    def windows(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Numbers of the windows of two runs of tokens over the same bytes, and where each begins: at a text's first byte, or where a token of A
        and one of B begin, both with a space."""
        starts_a, starts_b = (np.cumsum(side.length[x]) - side.length[x] for side, x in ((self.a, a), (self.b, b)))
        anchors = np.intersect1d(starts_a[self.a.spaced[a]], starts_b[self.b.spaced[b]], assume_unique=True)
        begins = np.union1d(anchors, first)
        at_a, at_b = (np.append(np.searchsorted(x, begins), len(x)) for x in (starts_a, starts_b))
        raw_a, raw_b, number, known = a.tobytes(), b.tobytes(), self.number, len(self.number)
        i, j = ((4 * x).tolist() for x in (at_a, at_b))
        numbers = [number.setdefault(raw_a[i0:i1] + _GAP + raw_b[j0:j1], len(number)) for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:])]
        if len(number) > known:
            new = np.diff(np.maximum.accumulate(np.array([known - 1, *numbers]))) > 0  # where a number comes first
            size_a, size_b = np.diff(at_a), np.diff(at_b)
            self.align(a[np.repeat(new, size_a)], b[np.repeat(new, size_b)], size_a[new], size_b[new])
        return numbers, begins

    def align(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> None:
        """Adds windows, whose tokens follow one another: groups as text and their number, and the links as a * 2^32 + b."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at_a, at_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        shared_a, shared_b = ends_b[at_a] == ends_a, ends_a[at_b] == ends_b
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        # between two ends, of either side, lies what one link shares: the place of a token's end among all is that of its last link
        last_a, last_b = np.arange(len(a)) + at_a - group_a, np.arange(len(b)) + at_b - group_b
        links = np.repeat(a.astype(np.int64), np.diff(last_a, prepend=-1)) << 32 | np.repeat(b.astype(np.int64), np.diff(last_b, prepend=-1))
        # the text: a group's tokens of A, then those of B; a separator behind each
        in_a, in_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        place_a, place_b = np.arange(len(a)) + (in_b - np.bincount(group_b))[group_a], np.arange(len(b)) + in_a[group_b]
        last, width = np.cumsum(size_b) - 1, self.digits.shape[1]
        said = np.full((len(a) + len(b), width + 1), ord(","), np.uint8)
        said[place_a, :width], said[place_b, :width] = self.digits[a], self.digits[b]
        said[place_a[shared_a], width], said[place_b[shared_b], width], said[place_b[last], width] = ord("|"), ord(";"), ord("\n")
        self.text += said.tobytes().translate(None, b"\0").decode().split("\n")[:-1]
        self.groups += np.diff(group_b[last] + 1, prepend=0).tolist()
        self.size_a += size_a.tolist()
        self.size_b += size_b.tolist()
        raw, ends = links.tobytes(), (8 * (last_b[last] + 1)).tolist()
        self.links += [raw[i:k] for i, k in zip([0, *ends], ends)]


@lru_cache(1)
def _sides(raw_a: bytes, raw_b: bytes) -> tuple[Side, Side, Windows]:
    a, b = ByteLevel(raw_a), Pieces(raw_b)
    return a, b, Windows(a, b)


#: A row for about 1 MB of texts: columns of their documents, the windows of all of them in order (codes), and what the distinct windows link.
CHUNK = "row array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, n_windows array<bigint>, codes binary, link_counts binary, links binary"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Chunks of documents: doc_id, CHUNK. groups: 'a1,a2|b1;a3|b2,b3', ids between shared ends. row: a number of each row's own."""
    spark = docs.sparkSession
    raw = []
    for path in paths or default_paths():
        with open(path, "rb") as f:
            raw.append(spark.sparkContext.broadcast(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _sides(raw[0].value, raw[1].value)[2]
        base, seen = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for part in parts(batch, 1, CHUNK_BYTES):
                owns = [own or () for own in windows.documents(part.column(1).to_pylist())]
                n = np.fromiter(map(len, owns), np.int64, len(owns))
                used = np.fromiter(chain.from_iterable(owns), np.int64, int(n.sum()))
                distinct, codes = np.unique(used, return_inverse=True)
                ends = np.cumsum(n)
                n_a, n_b, groups = (np.concatenate([[0], np.cumsum(np.array(x, np.int64)[used])]) for x in (windows.size_a, windows.size_b, windows.groups))
                n_a, n_b, groups = (x[ends] - x[ends - n] for x in (n_a, n_b, groups))
                text = [";".join(map(windows.text.__getitem__, own)) for own in owns]
                linked = [windows.links[i] for i in distinct.tolist()]
                values = [part.column(0).to_pylist(), np.arange(base + seen, base + seen + len(owns)), n_a, n_b, groups, n_a + n_b - groups, text, n]
                blobs = [codes.astype("<u4").tobytes(), np.array([len(x) // 8 for x in linked], "<u4").tobytes(), b"".join(linked)]
                types = [pa.list_(part.schema.field(0).type), *[pa.list_(t) for t in [pa.int64()] * 5 + [pa.string(), pa.int64()]]]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(owns)], pa.int32()), pa.array(v, t.value_type)) for v, t in zip(values, types)] + [pa.array([x], pa.binary()) for x in blobs]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "n_windows", "codes", "link_counts", "links"])
                seen += len(owns)
                windows.trim()
        windows.forget()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id array<{slim.schema['doc_id'].dataType.simpleString()}>, {CHUNK}")


def _pairs_of(batch: pa.RecordBatch, i: int):
    """Of a chunk: number of documents with windows, window occurrences as (document, window), links of the windows and where each one's begin."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
    n_windows = np.array(get("n_windows").as_py(), np.int64)
    codes, counts, links = (np.frombuffer(get(c).as_py(), t) for c, t in (("codes", "<u4"), ("link_counts", "<u4"), ("links", "<i8")))
    return n_windows, np.repeat(np.arange(len(n_windows)), n_windows), codes.astype(np.int64), counts.astype(np.int64), links


def _distinct(doc: np.ndarray, code: np.ndarray, counts: np.ndarray, links: np.ndarray):
    """Distinct (document, pair) with the number of times, and the distinct pairs: document, index of pair, times, pairs."""
    occurrences, times = np.unique(doc * max(1, len(counts)) + code, return_counts=True)
    doc, code = np.divmod(occurrences, max(1, len(counts)))
    pairs, index = np.unique(links, return_inverse=True)
    begin, n = (np.cumsum(counts) - counts)[code], counts[code]
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key, back = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + index[at], return_inverse=True)
    total = np.bincount(back, np.repeat(times, n), len(key)).astype(np.int64)
    doc, pair = np.divmod(key, max(1, len(pairs)))
    return doc, pair, total, pairs


def _by_document(of_link: np.ndarray, counts: np.ndarray, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums over the links of each document's windows, exactly; begin: where each document's windows begin, and the end."""
    at = np.concatenate([[0], np.cumsum(of_link.astype(np.int64))])
    ends = np.cumsum(counts)
    of_window = at[ends] - at[ends - counts]
    total = np.concatenate([[0], np.cumsum(of_window[code])])
    return total[begin[1:]] - total[begin[:-1]]


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, docs (how many documents have them linked), best (docs is a's highest; ties included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed():
            pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(back, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        def rows(pairs, docs):
            for k in range(0, len(pairs), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 17)]), pa.array(docs[k : k + (1 << 17)])], names=["pair", "docs"])

        held: list = []
        for batch in batches:
            for i in range(batch.num_rows):
                _, doc, code, counts, links = _pairs_of(batch, i)
                _, pair, _, pairs = _distinct(doc, code, counts, links)
                held.append((pairs, np.bincount(pair, minlength=len(pairs))))
                if sum(len(p) for p, _ in held) > PENDING:
                    held = [summed()]
                    if len(held[0][0]) > PENDING // 2:
                        yield from rows(*held[0])
                        held = []
        if held:
            yield from rows(*summed())

    counted = chunks.select("n_windows", "codes", "link_counts", "links").mapInArrow(run, "pair bigint, docs bigint")
    counted = counted.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32).cast("int"))
    with few_rows(chunks.sparkSession):
        counted = staged(counted, "alignment-pairs")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of a vocabulary
    return counted.join(most, "a").select("a", F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(chunks: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, row, n_a, n_b, n_groups, n_links, groups, n_best (links of a pair that is its A id's best), count_sum (counts of all links).
    chunks and counts: settled tables."""
    spark = chunks.sparkSession
    # the least count whose pairs are at most `frequent`, from counts by quarters of a power of two
    level = F.floor(F.log2("docs") * 4)
    room, cut = frequent, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 256 rows at most
        room -= r.n
        if room < 0:
            break
        cut = r.level
    known = counts.select("pair", "docs", "best").where(level >= cut if cut is not None else F.lit(False)).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["docs"].to_numpy(np.int64), known["best"].to_numpy(bool)))
    kept = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_of, docs_of, best_of = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                n_windows, doc, code, n, links = _pairs_of(batch, i)
                at = np.searchsorted(pair_of, links)
                at[at == len(pair_of)] = 0
                found = pair_of[at] == links if len(pair_of) else np.zeros(len(links), bool)
                begin = np.concatenate([[0], np.cumsum(n_windows)])
                sums, bests = (_by_document(np.where(found, x[at], 0) if len(pair_of) else np.zeros(len(links), np.int64), n, code, begin) for x in (docs_of, best_of))
                # what wasn't sent leaves as pairs, of the windows that have such
                lacks = np.zeros(len(n), bool)
                lacks[np.repeat(np.arange(len(n)), n)[~found]] = True
                some = lacks[code]
                doc, pair, times, pairs = _distinct(doc[some], code[some], n, links)
                rest = ~np.isin(pairs, links[found])[pair] if len(pairs) else np.zeros(0, bool)
                ends = np.searchsorted(doc[rest], np.arange(len(n_windows) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (pairs[pair[rest]], times[rest])]
                columns = [batch.column(batch.schema.get_field_index(c))[i].values for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bests), pa.array(sums), *lists], names=[*kept, "n_best", "count_sum", "rest", "times"])

    types = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema if f.name in kept}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best bigint, count_sum bigint, rest array<bigint>, times array<bigint>"
    rows = chunks.select(*kept, "n_windows", "codes", "link_counts", "links").mapInArrow(run, schema)
    with few_rows(spark):
        rows = staged(rows, "alignment-scores")
    if room >= 0:
        return rows.drop("rest", "times")  # all pairs were sent: nothing is left to join
    one = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    more = one.join(counts.select("pair", "docs", "best"), "pair").groupBy("row")
    more = more.agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return rows.drop("rest", "times").join(more, "row", "left").select(*kept, *sums)


def op11_space_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens, its digest, and how its links stand in the corpus."""
    chunks = aligned(read_table(spark, sf_dir, "documents"))
    digest = F.transform("groups", lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    with few_rows(spark, BATCH_ROWS):
        chunks = staged(chunks.withColumn("groups", digest), "alignment-chunks", **WIDE)
    counts = staged(pair_counts(chunks), "alignment-counts")
    return scored(chunks, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
