"""Embedding whitening by an exact characteristic polynomial.

Entries c become whole numbers x = floor(64 c) + 1000000, so the scatter matrix n * sum(x x') - S S' = n^2 V of the covariance V is a
matrix of integers, summed up exactly. Its characteristic polynomial is taken by Hessenberg reduction modulo 31-bit primes, a Spark
task for some primes each, until their product exceeds twice any coefficient, and put together by Chinese remaindering. All its roots are
real, so the sign changes of the polynomial shifted by a are exactly the number of roots above a (Descartes): each component's task
bisects for its root, by sign changes until it is alone in its interval and by signs beyond, to BITS bits. The null space of the
matrix less the root, by elimination with complete pivoting in fixed point and a step of inverse iteration, is the component.
Roots that agree in nearly all those bits share an orthonormal basis of their space.

Vectors are read in passes without shuffle; only d^2 sums a task are exchanged, d being the dimension: the driver holds d^2 numbers, which
suits dimensions up to some hundreds. Offsets don't change V and deviations, so x is kept without its 1000000.

Cases: rows whose vector is null or holds null or non-finite entries are dropped; so are rows of another length than most non-null vectors have (of
equally many, the longest; no entries at all: dropped). There are as many components as V has positive eigenvalues, `components` at
most: none for one row, equal rows or an empty table. Rows of equal or null id stay. Entries of any finite size count exactly; a
deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, floor, gcd, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

COMPONENTS = 32
BITS = 224  # of a root, from the highest that any root may have on
GUARD = 96  # further bits of the elimination
LIMB = 40  # bits of the parts in which whole numbers are summed
SCALE = 64


# --- whole-number sums over tasks ---------------------------------------------------------------------------------------------------


def _limbs(values: dict[int, int]) -> pa.RecordBatch:
    cells, limbs, parts = [], [], []
    for cell, value in values.items():
        sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            cells.append(cell)
            limbs.append(k)
            parts.append(sign * (rest & ((1 << LIMB) - 1)))
            rest, k = rest >> LIMB, k + 1
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(limbs, pa.int32()), pa.array(parts, pa.int64())], names=["cell", "limb", "part"])


def _total(parts: DataFrame) -> dict[int, int]:
    out: dict[int, int] = {}
    for r in parts.groupBy("cell", "limb").agg(F.sum("part").alias("part")).collect():  # d^2 cells
        out[r.cell] = out.get(r.cell, 0) + (r.part << (LIMB * r.limb))
    return out


PARTS = "cell bigint, limb int, part bigint"


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and entries of the rows that count."""
    vectors = batch.column(1)
    batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim))
    entries = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(entries).all(axis=1)
    return batch.column(0).filter(pa.array(fine)), entries[fine]


def _whole(entries: np.ndarray) -> np.ndarray:
    """floor(64 c): int64, or Python's integers where that may not do."""
    if entries.size == 0 or np.abs(entries).max() < 2.0**40:
        return np.floor(entries * SCALE).astype(np.int64)
    return np.vectorize(lambda c: int(c) * SCALE if abs(c) >= 2.0**53 else floor(c * SCALE), otypes=[object])(entries)


def _gram(x: np.ndarray) -> np.ndarray:
    """x' x in Python's integers, by floating point where all partial sums are whole numbers that it holds."""
    dim = x.shape[1]
    total, most = np.zeros((dim, dim), object), int(np.abs(x).max()) if x.size else 0
    rows = (1 << 53) // max(1, most * most)
    if rows < 1:
        x = x.astype(object)
        return x.T.dot(x)
    for k in range(0, len(x), min(rows, 1 << 16)):
        block = x[k : k + min(rows, 1 << 16)].astype(np.float64)
        total += (block.T @ block).astype(np.int64).astype(object)
    return total


def scatter(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and sum(x x') of the rows that count, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            x = _whole(_rows(b, dim)[1])
            n += len(x)
            sums = sums + x.astype(object).sum(axis=0) if x.dtype == object or len(x) == 0 else sums + x.sum(axis=0).astype(object)
            products = products + _gram(x)
        values = {dim * dim: n} | {dim * dim + 1 + i: int(v) for i, v in enumerate(sums)}
        yield _limbs(values | {i * dim + j: int(products[i, j]) for i in range(dim) for j in range(i, dim)})

    at = _total(vectors.mapInArrow(run, PARTS))
    n, sums = at.get(dim * dim, 0), [at.get(dim * dim + 1 + i, 0) for i in range(dim)]
    return n, sums, [[at.get(min(i, j) * dim + max(i, j), 0) for j in range(dim)] for i in range(dim)]


# --- the characteristic polynomial --------------------------------------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # proves it below 3.2 * 10^9
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes(above: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds the number."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= above:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def modular_polynomial(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - matrix) modulo p, lowest first: reduction to Hessenberg form by similar matrices, then the recurrence over
    its leading minors."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k, :-1]
        row = (row - int(h[k, k]) * minors[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            row = (row - chain * int(h[i, k]) % p * minors[i]) % p
        minors[k + 1] = row
    return minors[d].tolist()


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t I - matrix) of a positive semidefinite matrix of integers, lowest first, exactly."""
    d = len(matrix)
    mean = Fraction(sum(matrix[i][i] for i in range(d)), d)
    bound = max(floor(comb(d, k) * mean**k) + 1 for k in range(d + 1))  # of roots with this sum, equal ones have the largest symmetric functions
    chosen = primes(2 * bound)
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([modular_polynomial(sent.value, p) for p in found], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(chosen), 64)
    rows = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(tasks).mapInArrow(run, "p bigint, c array<bigint>").collect()  # d + 1 numbers for each prime
    value, product = [0] * (d + 1), 1
    for r in rows:
        step = pow(product % r.p, -1, r.p)
        value = [v + product * ((c - v) * step % r.p) for v, c in zip(value, r.c)]
        product *= r.p
    return [v - product if 2 * v > product else v for v in value]


# --- roots --------------------------------------------------------------------------------------------------------------------------


def above(p: list[int], a: int, shift: int) -> int:
    """How many roots of p, all real, exceed a * 2^shift, by multiplicity: the sign changes of p moved by that much."""
    c = p if shift >= 0 else [v << (-shift * (len(p) - 1 - k)) for k, v in enumerate(p)]
    a = a << shift if shift >= 0 else a
    c = c[:]
    if a:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign(p: list[int], a: int, shift: int) -> int:
    """Sign of p(a * 2^shift)."""
    if shift > 0:
        a, shift = a << shift, 0
    value, scale = 0, 0
    for c in reversed(p):
        value = value * a + (c << scale)
        scale -= shift
    return (value > 0) - (value < 0)


def root(p: list[int], top: int, k: int) -> tuple[int, int, int]:
    """The k-th largest root (from 1, by multiplicity) of p, whose roots are real and lie in [0, 2^top]: (z, how many roots are larger than those
    that share its interval, how many share it); the root lies in (z, z + 1] * 2^(top - BITS)."""
    a, shift, left, right = 0, top, above(p, 0, 0), 0  # roots above a * 2^shift, and above (a + 1) * 2^shift
    while shift > top - BITS:
        if left - right == 1:
            low = sign(p, a + 1, shift)
            if low:  # the sign just above the root; a root on the edge stays with the counts
                while shift > top - BITS:
                    a, shift = 2 * a, shift - 1
                    at = sign(p, a + 1, shift)
                    a += at not in (low, 0)
                break
        a, shift = 2 * a, shift - 1
        middle = above(p, a + 1, shift)
        if middle >= k:
            a, left = a + 1, middle
        else:
            right = middle
    return a, right, left - right


def eigenspace(matrix: list[list[int]], z: int, top: int, size: int) -> list[list[int]]:
    """An orthonormal basis, in fixed point of BITS + GUARD bits, of the space of the `size` roots next to (z + 1/2) * 2^(top - BITS)."""
    d, bits = len(matrix), BITS + GUARD
    one = 1 << bits
    half = (2 * z + 1) << (GUARD - 1)
    m = [[(v << (bits - top) if bits >= top else v >> (top - bits)) - (half if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    rows, cols = list(range(d)), list(range(d))
    factors: list[list[int]] = []
    for k in range(d):
        i, j = max(((i, j) for i in range(k, d) for j in range(k, d)), key=lambda at: abs(m[at[0]][at[1]]))
        m[k], m[i], rows[k], rows[i] = m[i], m[k], rows[i], rows[k]
        for f in factors:
            f[k], f[i] = f[i], f[k]
        if j != k:
            cols[k], cols[j] = cols[j], cols[k]
            for row in m:
                row[k], row[j] = row[j], row[k]
        pivot, own = m[k][k] or 1, [0] * d
        m[k][k] = pivot
        for i in range(k + 1, d):
            own[i] = (m[i][k] << bits) // pivot
            if own[i]:
                f, up = own[i], m[k]
                row = m[i]
                for j in range(k + 1, d):
                    row[j] -= (f * up[j]) >> bits
        factors.append(own)

    def back(right: list[int], last: int) -> list[int]:
        """Solves the upper triangle's first `last` rows for the unknowns before `last`."""
        x = right[:]
        for i in range(last - 1, -1, -1):
            rest = right[i] - (sum(m[i][j] * x[j] for j in range(i + 1, d)) >> bits)
            x[i] = (rest << bits) // m[i][i]
        return x

    def unit(v: list[int], basis: list[list[int]]) -> list[int]:
        v = [(x << bits) // most for x in v] if (most := max(map(abs, v))) else v
        for _ in range(2):
            for b in basis:
                dot = sum(x * y for x, y in zip(v, b)) >> bits
                v = [x - ((dot * y) >> bits) for x, y in zip(v, b)]
        length = isqrt(sum(x * x for x in v))
        return [(x << bits) // length for x in v]

    basis: list[list[int]] = []
    for t in range(d - size, d):
        start = [0] * d
        start[t] = one
        v = [0] * d
        for at, x in zip(cols, back(start, d - size)):
            v[at] = x
        v = unit(v, basis)
        if size == 1:  # a step of inverse iteration from the null vector
            right = [v[r] for r in rows]
            for k in range(d):
                f, x = factors[k], right[k]
                for i in range(k + 1, d):
                    right[i] -= (f[i] * x) >> bits
            for at, x in zip(cols, back(right, d)):
                v[at] = x
            v = unit(v, basis)
        basis.append(v)
    return basis


def components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(root, unit vector) of the largest positive roots of a positive semidefinite matrix of integers, falling; a Spark task each."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return []
    common = gcd(*(v for row in matrix for v in row))
    matrix = [[v // common for v in row] for row in matrix]
    p, top = polynomial(spark, matrix), (trace // common).bit_length()
    wanted = min(most, above(p, 0, 0))
    sent = spark.sparkContext.broadcast((p, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, matrix = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                z, larger, shared = root(p, top, k)
                v = eigenspace(matrix, z, top, shared)[k - 1 - larger]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(2 * z + 1)]), pa.array([[float(Fraction(x, 1 << (BITS + GUARD))) for x in v]], pa.list_(pa.float64()))], names=["k", "z", "v"])

    rows = spark.range(1, wanted + 1, numPartitions=wanted).mapInArrow(run, "k bigint, z string, v array<double>").collect()
    unit = common * Fraction(2) ** (top - BITS - 1)
    return [(int(r.z) * unit, r.v) for r in sorted(rows, key=lambda r: r.k)]


# --- the transform ------------------------------------------------------------------------------------------------------------------


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """The id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that counts and each component."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = slim.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = first.dim
    n, sums, products = scatter(slim, dim)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    found = components(spark, matrix, most)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(dim))
    explained = [float(value / trace) for value, _ in found]
    # value = n^2 e: dividing n x - S by n and by the root of e is dividing by the root of value
    turn = np.array([v for _, v in found]).T / np.array([_float_root(value) for value, _ in found])
    known, k = spark.sparkContext.broadcast((n, sums, turn)), len(found)

    def deviations(x: np.ndarray) -> np.ndarray:
        n, sums, _ = known.value
        if x.dtype != object and n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)

    def squares(dev: np.ndarray) -> list[int | None]:
        if dev.dtype != object and dev.size and int(np.abs(dev).max()) ** 2 * dev.shape[1] < 1 << 63:
            return (dev * dev).sum(axis=1).tolist()
        dev = dev.astype(object)
        return [v if v < 1 << 63 else None for v in (dev * dev).sum(axis=1)] if len(dev) else []

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = deviations(_whole(_rows(b, dim)[1])).astype(np.float64) @ known.value[2]
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        yield _limbs({i * (k + 1) + j: int(Fraction(total[i, j]) * (1 << 80)) for i in range(k + 1) for j in range(i, k + 1)})

    at = _total(slim.mapInArrow(covariance, PARTS))
    mean = lambda i, j: at.get(i * (k + 1) + j, 0) / (n << 80)
    error = max(abs(mean(i, j) - mean(i, k) * mean(j, k) - (i == j)) for i in range(k) for j in range(i, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                ids, entries = _rows(whole.slice(begin, 2048), dim)
                dev = deviations(_whole(entries))
                y, rows = dev.astype(np.float64) @ known.value[2], len(dev)
                every = np.repeat(np.arange(rows), k)
                columns = [ids.take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), pa.array(squares(dev), pa.int64()).take(pa.array(every))]
                columns += [pa.array(y.reshape(-1)), pa.array(np.tile(np.array(explained), rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return slim.mapInArrow(run, schema)


def _float_root(value: Fraction) -> float:
    """The square root as double, of a number of any size."""
    shift = 2 * max(0, 128 - value.numerator.bit_length() + value.denominator.bit_length())
    return float(Fraction(isqrt((value.numerator << shift) // value.denominator), 1 << (shift // 2)))


def op13_characteristic_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, 32 components at most."""
    return whitened(read_table(spark, sf_dir, "embeddings"))
