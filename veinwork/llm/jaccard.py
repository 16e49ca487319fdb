"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct shingles (op3: of 4 words). Sets fall into size bands so narrow that
sets similar enough (op3: Jaccard similarity >= 0.85) are in the same or neighbouring bands, and then differ in at most k features, k fixed
for a band. The feature domain is cut by hash into n1 groups of n2 parts; a signature is the content of n2 - k2
parts of one group, for every such subset. Two sets with at most k differences have a group with at most k2 of
them, so they share a signature. A set whose own content leaves too many groups thin (an empty subset could then
be all that a pair shares) emits its empty subsets too; the others skip them. Every set emits for its own band
and the next one.

1. One pass over the texts makes signatures; those of equal sets (copies) leave a task once. They are packed by
   partition, shuffled once and sorted there; equal signatures make a bucket.
2. Every bucket's hubs, the sets in most buckets (of two components, once there are components), are paired with its
   others: linear, however large a group of copies. Counts in BINS hashed bins bound the difference from below and drop
   most false pairs, counts in about as many bins as a set has features most others; the rest is verified on the sets.
   Links make components; up to ROUNDS times, fewer if that leaves few pairs or adds little.
3. Buckets that still hold several components get their remaining pairs across components, in blocks of
   BLOCK sets, under the same bound; survivors are verified. Pairs within a component can't change the result.

So no link between different sets is lost and none is made without verification.

Cases: null or blank text has an empty set, linked with nothing; shorter than a shingle, the whole sequence is one
shingle; sets of fewer than num / (den - num) shingles (op3: up to 5) link only when equal; repeated rows and ids are documents like any other (a
component's id is its smallest non-null doc_id; one_of_each() judges rows by id and text); an empty table gives no rows; extra columns are ignored.
Sets count as equal when size and 64-bit hash agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, read_table, staged
from .components import components
from .mixing import row_hash

#: op3's shingle length and least similarity, NUM / DEN; groups() and one_of_each() take others.
WORDS, NUM, DEN = 4, 85, 100
BINS, BLOCK, ROUNDS = 256, 2000, 3
#: Open buckets that leave so few pairs to a member, or a round that adds less than one in ENOUGH to the links, end the rounds.
FEW, ENOUGH = 128, 20
#: Pairs of a block that are looked at together, and of them, those whose counts are.
PAIRS, HISTOGRAMS = 200_000, 10_000
#: Bytes of text to a partition of signatures, which take about as many.
PART_BYTES = 48 << 20
#: Rows with texts or sets that go to Python at once, and signatures that a task holds before it packs them.
ROWS, HELD = 512, 250_000
#: Candidate texts up to this many are marked by a broadcast of their keys, beyond it by a shuffle join.
BROADCAST_KEYS = 1_000_000
_A, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.array([_A, 1, 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, words: Words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text, A-Z lower-cased; bytes.split() cuts at ASCII white space."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    span = min(size, len(w))
    h = ids[: len(w) - span + 1].copy()
    for i in range(1, span):
        h = h * _A + ids[i : len(w) - span + 1 + i]
    return np.unique(mix(h + np.uint64(span)))


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set, signed."""
    parts = np.array([s.sum(dtype=np.uint64), (s * s).sum(dtype=np.uint64), len(s)], np.uint64) * _POWERS
    return int(mix(parts.sum(keepdims=True)).view(np.int64)[0])


def smallest(num: int = NUM, den: int = DEN) -> int:
    """The least size at which two different sets can be linked."""
    return -(-num // (den - num))


def bands(longest: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    out, lo = [], smallest(num, den)
    while lo <= longest:
        hi = lo * den // num
        out.append((lo, hi))
        lo = hi + 1
    return out


def scheme(lo: int, hi: int, num: int = NUM, den: int = DEN) -> tuple[int, int, int, int]:
    """(n1, n2, k2, need) of a band: need good groups make a set safe. n1 leaves so few sets unsafe as 1 in 10^4, or as can be."""
    k = 2 * hi * (den - num) // (den + num)
    k2, n2 = 1, (3 if k < 24 else 2)
    need, best = k // (k2 + 1) + 1, None
    least = max(1, lo * num // den)  # the smallest sets that emit for this band come from the one below
    for n1 in range(need, 2 * need + 3):
        empty = math.exp(-least / (n1 * n2))
        bad = 1 - ((1 - empty) ** 2 if n2 == 2 else (1 - empty) ** 3 + 3 * empty * (1 - empty) ** 2)
        slack, risk, term = n1 - need, 1.0, 1.0
        mean = n1 * bad
        total = term = math.exp(-mean)
        for i in range(1, slack + 1):
            term *= mean / i
            total += term
        risk = 1 - total
        if best is None or risk < best[0]:
            best = (risk, n1)
        if risk < 1e-4:
            break
    return best[1], n2, k2, need


def _edges(parts: int) -> np.ndarray:
    return (np.arange(1, parts, dtype=np.uint64) * np.uint64(2**63 // parts)) * np.uint64(2)


class Signer:
    def __init__(self, num: int = NUM, den: int = DEN) -> None:
        self.num, self.den, self.least = num, den, smallest(num, den)
        self.bands: list[tuple[int, int]] = []
        self.plans: dict[int, tuple] = {}

    def band(self, n: int) -> int:
        if not self.bands or self.bands[-1][1] < n:
            self.bands = bands(2 * n, self.num, self.den)
        return int(np.searchsorted([hi for _, hi in self.bands], n))

    def plan(self, i: int) -> tuple:
        if i not in self.plans:
            if len(self.bands) <= i:
                self.bands = bands(4 * self.bands[-1][1], self.num, self.den)
            n1, n2, k2, need = scheme(*self.bands[i], self.num, self.den)
            code = mix((np.arange(n1 * 3, dtype=np.uint64) + np.uint64(1)) * _A + np.array([i], np.uint64) * _M1)
            self.plans[i] = (n1, n2, need, _edges(n1 * n2), code)
        return self.plans[i]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """s: a set in order. Its signatures, none for sets that only equal ones are linked with."""
        if len(s) < self.least:
            return np.empty(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)])
        out, own = [], self.band(len(s))
        for i in (own, own + 1):
            n1, n2, need, edges, code = self.plan(i)
            at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
            content = mix(np.diff(sums[at])).reshape(n1, n2)
            full = (np.diff(at) > 0).reshape(n1, n2)
            if n2 == 2:  # subsets of one part
                sig, some = mix(content.ravel() + code[: n1 * 2]), full.ravel()
                good = int((full.sum(1) == 2).sum())
            else:  # subsets of two parts of three
                a, b = content, np.roll(content, -1, axis=1)
                sig, some = mix(a.ravel() * _M1 + b.ravel() + code[: n1 * 3]), (full | np.roll(full, -1, axis=1)).ravel()
                good = int((full.sum(1) >= 2).sum())
            out.append(sig[some] if good >= need else sig)
        return np.concatenate(out)


def _histogram(s: np.ndarray) -> bytes:
    """Counts in bins by the low bits; held at 255, which only lowers the bound."""
    return np.minimum(np.bincount(s.astype(np.uint8), minlength=BINS), 255).astype(np.uint8).tobytes()


FOUND = "part int, doc_id bigint, text_key bigint, n bigint, node bigint, hist binary, nodes binary, sigs binary"


def _short(sig: np.ndarray) -> bytes:
    """The upper five bytes of each. A partition tells apart by its number what they don't; equal ones only make a bucket, never a link."""
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _long(sig: bytes) -> np.ndarray:
    out = np.zeros((len(sig) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(sig, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _sign(parts: int, length: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer, seen = Words(), Signer(num, den), set()
        held: tuple[list, list] = ([], [])
        size = turn = 0

        def packed() -> pa.RecordBatch:
            sig, node = np.concatenate(held[0]), np.concatenate(held[1])
            part = (sig % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            has = np.flatnonzero(np.diff(cut))
            rows = [order[cut[p] : cut[p + 1]] for p in has]
            none = [None] * len(has)
            return _batch(has.tolist(), none, none, none, none, none, [node[r].tobytes() for r in rows], [_short(sig[r]) for r in rows])

        for b in batches:
            ids, keys, n, node, hist = b.column(0).to_pylist(), b.column(2).to_pylist(), [], [], []
            for text in b.column(1):
                s = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", words, length)
                n.append(len(s))
                node.append(key := set_key(s))
                hist.append(_histogram(s))
                if key not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    sig = signer.signatures(s)
                    held[0].append(sig)
                    held[1].append(np.full(len(sig), key, np.int64))
                    size += len(sig)
            none = [None] * len(ids)
            # documents are dealt in turn, from another partition on in every task; only signatures must meet
            turn = (turn or words[str(ids).encode()]) + len(ids)
            yield _batch([(turn + i) % parts for i in range(len(ids))], ids, keys, n, node, hist, none, none)
            if size > HELD:
                yield packed()
                held, size = ([], []), 0
        if size:
            yield packed()

    return run


def _batch(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents pass through; the packed signatures of the partition become bucket members: part -1, doc_id: their
    number, node, n: the bucket's key. A bucket is named by its members, so it leaves once."""
    sigs, nodes = [], []
    for b in batches:
        packed = b.column(7).is_valid().to_numpy(zero_copy_only=False)
        if not packed.all():
            yield b.filter(pa.array(~packed))
        for i in np.flatnonzero(packed):
            sigs.append(_long(b.column(7)[i].as_py()))
            nodes.append(np.frombuffer(b.column(6)[i].as_py(), np.int64))
    if not sigs:
        return
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    del sigs, nodes
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(start, len(sig)))
    key = np.add.reduceat(mix(node.view(np.uint64) + _A), start)
    many = count > 1
    _, first = np.unique(key[many], return_index=True)
    run = np.flatnonzero(many)[first]
    for at in range(0, len(run), 50_000):
        r = run[at : at + 50_000]
        member = np.repeat(start[r], count[r]) + np.arange(count[r].sum()) - np.repeat(np.cumsum(count[r]) - count[r], count[r])
        for lo in range(0, len(member), 200_000):
            m = member[lo : lo + 200_000]
            owner = np.repeat(np.arange(len(r)), count[r])[lo : lo + 200_000]
            none = pa.nulls(len(m), pa.binary())
            cols = [pa.array(np.full(len(m), -1, np.int32)), pa.array(count[r][owner]), pa.nulls(len(m), pa.int64()), pa.array(key[r].view(np.int64)[owner]), pa.array(node[m]), none, none, none]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])


def _close(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Can sets of these sizes that differ in apart features or more be linked? For op3: 185 * apart <= 15 * (n_a + n_b)."""
    return (den + num) * apart <= (den - num) * (n_a + n_b)


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose sizes and bins allow a link."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("hist").alias("h" + x))
    # the size bound alone, before the bins are looked at
    sized = pairs.join(one("a"), "a").join(one("b"), "b").where(((den + num) * F.abs(F.col("na") - F.col("nb"))) <= (den - num) * (F.col("na") + F.col("nb")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ha, hb = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("ha", "hb"))
                yield f.loc[_close(f.na.to_numpy(), f.nb.to_numpy(), np.abs(ha - hb).sum(1), num, den), ["a", "b"]]

    return sized.mapInPandas(run, "a bigint, b bigint")


def _open(sized: DataFrame, comps: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets of three sets or more that hold several components."""
    told = sized.where("size > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    several = told.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    return staged(told.join(several, "bucket", "left_semi"), "jaccard-open")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): in each bucket the best set, outside the best one's component if there are several, with all others outside its own."""
    first = members.groupBy("bucket").agg(F.max(F.struct("rank", "comp")).alias("best"))
    rest = members.join(first, "bucket").where("comp <> best.comp").groupBy("bucket").agg(F.max(F.struct("rank", "comp")).alias("second"))
    pick = first.join(rest, "bucket", "left").select("bucket", F.explode(F.array_compact(F.array("best", "second"))).alias("hub"))
    pairs = members.join(pick, "bucket").where("comp <> hub.comp").select("node", F.col("hub.rank.node").alias("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _behind(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): every row a with each of the count[a] rows right behind it; about PAIRS at once."""
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, to), count[at:to])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(done[at:to] - done[at], count[at:to])
        at = to


def _across(dirty: DataFrame, num: int, den: int) -> DataFrame:
    """dirty: (bucket, node, comp, n, hist, blocks). Pairs across components of a bucket that sizes and bins allow. Most buckets are small and
    there are many, so those of an Arrow batch are taken together, each in order of size."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = dirty.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp", "n", "hist")

    def group(t: pa.Table) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.any([x[1:] != x[:-1] for x in (t[c].to_numpy() for c in ("bucket", "lo", "hi"))], axis=0))])

    def allowed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """t: whole groups."""
        lo, hi, own, node, comp, n = (t[c].to_numpy() for c in ("lo", "hi", "own", "node", "comp", "n"))
        h = np.frombuffer(b"".join(t["hist"].to_pylist()), np.uint8).reshape(-1, BINS)
        odd = np.packbits(h & 1, axis=1).view(np.uint64)
        # sizes of a group follow one another, so those that allow a link with a row lie right behind it
        base = group(t) << 40
        last = np.searchsorted(base + n, base + n * den // num, "right")
        for a, b in _behind(last - np.arange(len(n)) - 1):
            some = (comp[a] != comp[b]) & ((lo[a] == hi[a]) | (own[a] != own[b]))
            a, b = a[some], b[some]
            # bins of unlike parity differ by one at least: a weaker bound than that of the counts, but a cheap one
            some = _close(n[a], n[b], np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64), num, den)
            a, b = a[some], b[some]
            for at in range(0, len(a), HISTOGRAMS):
                x, y = a[at : at + HISTOGRAMS], b[at : at + HISTOGRAMS]
                some = _close(n[x], n[y], np.abs(h[x].astype(np.int16) - h[y]).sum(1), num, den)
                x, y = node[x[some]], node[y[some]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                t = pa.concat_tables([*rest, pa.Table.from_batches([b])])
                g = group(t)
                begun = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                rest = [t.slice(begun)]
                if begun:
                    yield from allowed(t.slice(0, begun))
        if rest:
            yield from allowed(rest[0])

    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _fine(s: np.ndarray) -> bytes:
    """Counts in bins by the low bits, about as many bins as the set has features; held at 255."""
    bins = max(BINS, 1 << (len(s) - 1).bit_length()) if len(s) else BINS
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """What two sets differ in at least, by their bins; of more bins, those that fewer ones hold together are added up."""
    bins = min(len(x), len(y))
    x, y = (h.reshape(-1, bins).sum(0, dtype=np.int64) for h in (x, y))
    return int(np.abs(x - y).sum())


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(node, part, n, fine, features) of the wanted nodes, from one document of each; of repeated rows, once from each task that has them."""
    keys = nodes.join(wanted, "node", "left_semi").select("at.doc_id", "at.text_key").distinct()
    keys = staged(keys.select(F.col("doc_id").alias("__vw_id"), F.col("text_key").alias("__vw_key")), "jaccard-keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    chosen = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__vw_id")) & (F.col("text_key") == F.col("__vw_key")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = Words(), set(), TaskContext.get().partitionId()
        for b in batches:
            new = {}
            for t in b.column(0):
                s = shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", words, length)
                if (key := set_key(s)) not in seen:
                    seen.add(key)
                    new[key] = s
            columns = [pa.array(list(new), pa.int64()), pa.array([part] * len(new), pa.int32()), pa.array([len(s) for s in new.values()], pa.int64())]
            columns += [pa.array([f(s) for s in new.values()], pa.binary()) for f in (_fine, np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "part", "n", "fine", "features"])

    return staged(chosen.mapInArrow(run, "node bigint, part int, n bigint, fine binary, features binary"), "jaccard-sets")


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with these columns of rows (by node) for a and for b."""
    for x in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in columns)), x)
    return pairs


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, length: int, num: int, den: int) -> DataFrame:
    """The (a, b) of pairs that are links. Sets travel with those pairs only that finer bins allow."""
    pairs = staged(pairs, "jaccard-pairs")
    if not pairs.limit(1).count():
        return pairs
    ends = lambda df: df.select(F.col("a").alias("node")).unionByName(df.select(F.col("b").alias("node"))).distinct()

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            na, nb = t["na"].to_numpy(), t["nb"].to_numpy()
            apart = [_apart(*(np.frombuffer(x.as_buffer(), np.uint8) for x in xy)) for xy in zip(t["finea"], t["fineb"], strict=True)]
            t = t.select(["a", "b"]).filter(pa.array(_close(na, nb, np.array(apart, np.int64), num, den), pa.bool_()))
            yield from t.to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            ok = []
            for x, y in zip(t["featuresa"], t["featuresb"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * same >= num * (len(x) + len(y) - same))
            t = t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield from t.to_batches()

    with few_rows(docs.sparkSession, ROWS):
        sets = _sets(docs, nodes, ends(pairs), length)
        one = sets.groupBy("node").agg(F.min(F.struct("part", "n", "fine")).alias("x")).select("node", "x.n", "x.fine")
        near = staged(_both(pairs, one, ["n", "fine"]).mapInArrow(allowed, "a bigint, b bigint"), "jaccard-near")
        first = sets.groupBy("node").agg(F.min("part").alias("part"))
        wanted = staged(first.join(ends(near), "node", "left_semi"), "jaccard-wanted")
        if wanted.count() <= BROADCAST_KEYS:
            wanted = F.broadcast(wanted)
        sets = sets.join(wanted, ["node", "part"], "left_semi")
        return staged(_both(near, sets, ["features"]).mapInArrow(linked, "a bigint, b bigint"), "jaccard-links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n and at (none, doc_id, text_key) for every row of docs: the first row of its component by id, nulls last, and text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a task that sorts signatures holds a partition of them, so their number follows the input
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key"))
    with few_rows(spark, ROWS):
        found = staged(docs.mapInArrow(_sign(parts, words, num, den), FOUND).repartitionById(parts, F.col("part")).mapInArrow(_buckets, FOUND), "jaccard")
    rows = found.where("part >= 0").select("doc_id", "text_key", "n", "node", "hist")
    nodes = staged(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("at"), F.first("n").alias("n"), F.first("hist").alias("hist")), "jaccard-nodes")
    sized = staged(found.where("part = -1").select(F.col("n").alias("bucket"), "node", F.col("doc_id").alias("size")).distinct(), "jaccard-members")
    # the set in the largest and most buckets is the least changed copy of a group
    score = sized.groupBy("node").agg(F.sum("size").alias("score"))
    sized = staged(sized.join(score, "node").select("bucket", "node", "size", F.struct("score", "node").alias("rank")), "jaccard-sized")

    tested, comps = spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "node bigint, root bigint")
    dirty = sized.withColumn("comp", F.col("node"))
    known = 0
    for _ in range(ROUNDS):
        star = staged(_stars(dirty), "jaccard-stars")
        more = _verified(docs, nodes, _possible(star.join(tested, ["a", "b"], "left_anti"), nodes, num, den), words, num, den)
        tested = tested.unionByName(star).distinct()
        if not (new := more.count()):  # the next hubs would be the same
            break
        comps = components(comps.toDF("a", "b").unionByName(more))
        dirty = _open(sized, comps)
        if new * ENOUGH < known or (dirty.agg(F.avg("size")).first()[0] or 0) <= 2 * FEW:
            break
        known += new
    dirty = dirty.join(nodes.select("node", "n", "hist"), "node").drop("rank")
    more = _across(dirty.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), num, den).join(tested, ["a", "b"], "left_anti")
    last = _verified(docs, nodes, more, words, num, den)
    if last.limit(1).count():
        comps = components(comps.toDF("a", "b").unionByName(last))

    # one row per set: its component's first row
    named = nodes.select("node", "at").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("at").alias("at"))
    return rows.join(named.select("node", "root").join(roots, "root").select("node", "at"), "node").select("doc_id", "text_key", "n", "at")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row of docs; links take a similarity of num / den or more of shingles of so many words."""
    out = _grouped(docs, id_col, text_col, words, num, den)
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("at.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _of(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """The rows of docs whose id (null like any other) and text are among those of rows (how: left_semi), or are not (left_anti)."""
    rows = rows.select(F.col("doc_id").alias("__vw_id"), F.col("text_key").alias("__vw_key"))
    if rows.count() <= BROADCAST_KEYS:
        rows = F.broadcast(rows)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(rows, F.col(id_col).cast("bigint").eqNullSafe(F.col("__vw_id")) & (key == F.col("__vw_key")), how)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each component, the first by doc_id (nulls last) and text; of repeated rows (equal id and text), one stays,
    by a hash of all columns.
    Rows are told apart by id and text, so rows that share an id, or have none, are judged each by its own text. Of texts
    without words only repeated rows that have an id go."""
    out = staged(_grouped(docs, id_col, text_col, words, num, den), "jaccard-groups")
    first = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("text_key") == F.col("at.text_key"))
    kept = _of(docs, staged(out.where((F.col("n") > 0) & ~first).select("doc_id", "text_key").distinct(), "jaccard-drop"), id_col, text_col, "left_anti")
    stays = out.where((F.col("n") > 0) & first | (F.col("n") == 0) & F.col("doc_id").isNotNull())
    repeated = staged(stays.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "jaccard-repeated")
    if repeated.limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__vw_row")
        many = _of(kept, repeated, id_col, text_col, "left_semi").select(whole, F.col(id_col).alias("__vw_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__vw_key"), row_hash(docs.dtypes).alias("__vw_hash"))
        one = many.groupBy("__vw_id", "__vw_key").agg(F.min_by("__vw_row", "__vw_hash").alias("__vw_row")).select("__vw_row.*")
        kept = _of(kept, repeated, id_col, text_col, "left_anti").unionByName(one)
    return kept


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
