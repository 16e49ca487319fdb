"""op13: polynomial and roots against exact arithmetic, rows against numpy's eigenvectors, and awkward tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from veinwork.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<double>, component string, n string, id string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n", "i", "v") for i, v in rows], SCHEMA).repartition(3)


def fractions_polynomial(m):
    """Faddeev-LeVerrier over fractions, lowest first."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)] if k > 1 else [[Fraction(i == j) for j in range(d)] for i in range(d)]
        ab = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
    return [int(x) for x in reversed(c)]


def gram(r, d, rank, size):
    x = [[r.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(v[i] * v[j] for v in x) for j in range(d)] for i in range(d)]


def test_primes_are_the_largest_below_2_31():
    some = w.primes(10**60)
    assert some[:3] == [2147483647, 2147483629, 2147483587] and all(all(p % q for q in range(3, 46341, 2)) for p in some)
    assert math.prod(some) > 10**60 >= math.prod(some[:-1])


def test_polynomial_modulo_a_prime():
    r = random.Random(1)
    for d in (1, 2, 3, 5, 8):
        for rank in (d, max(1, d // 2)):
            m = gram(r, d, rank, 50)
            m2 = [[0 if r.random() < 0.4 and i != j else v for j, v in enumerate(row)] for i, row in enumerate(m)]  # zero pivots; not symmetric
            for x in (m, m2, [[0] * d for _ in range(d)]):
                for p in (10007, 2147483647):
                    assert w.modular_polynomial(x, p) == [c % p for c in fractions_polynomial(x)]


def test_polynomial_is_exact(spark):
    m = gram(random.Random(2), 9, 20, 10**6)
    assert w.polynomial(spark, m) == fractions_polynomial(m)


def test_roots_with_equal_and_whole_ones():
    def times(p, q):
        out = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                out[i + j] += a * b
        return out

    roots = [16, 9, 9, 9, 8, 4, 1, 0, 0]
    p = [1]
    for x in roots:
        p = times(p, [-x, 1])
    top = sum(roots).bit_length()
    for k, x in enumerate(roots[:7], 1):
        z, larger, shared = w.root(p, top, k)
        low, high = Fraction(z) * Fraction(2) ** (top - w.BITS), Fraction(z + 1) * Fraction(2) ** (top - w.BITS)
        assert low < x <= high and larger == sum(y > x for y in roots) and shared == roots.count(x)
    for x in (0, 1, 8, 9, 15, 16):
        assert w.above(p, x, 0) == sum(y > x for y in roots) and w.above(p, 2 * x + 1, -1) == sum(y > x for y in roots)
    p = times([-2, 0, 1], [1])  # the root of 2 among both
    z = w.root(times(p, [0, 1]), 3, 1)[0]
    assert abs(Fraction(z) * Fraction(2) ** (3 - w.BITS) - Fraction(math.isqrt(2 << 400), 1 << 200)) < Fraction(1, 1 << 190)


def check(rows, got, most=32):
    """Rows against exact sums and numpy's eigenvectors; equal eigenvalues may turn, so whitened is judged by its products."""
    x = [[math.floor(Fraction(c) * 64) + 1000000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    total = [sum(v[i] for v in x) for i in range(d)]
    dev = [[n * v[i] - total[i] for i in range(d)] for v in x]
    c = np.array([[float(Fraction(e, n)) for e in v] for v in dev])
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    k = len(next(iter(by.values()))) if by else 0
    y = []
    for (i, _), e in zip(rows, dev):
        own = by[i]
        assert sorted(own) == list(range(1, k + 1))
        for m in own.values():
            exact = sum(t * t for t in e)
            assert m.n == n and m.deviation == (exact if exact < 1 << 63 else None) and m.identity_error < 1e-9
            assert m.explained == pytest.approx(values[m.component - 1] / values.sum(), rel=1e-6)
        y.append([own[m].whitened for m in range(1, k + 1)])
    y = np.array(y)
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-9
    # unit components: the projections, scaled back, solve V a = e a
    a = y * np.sqrt(values[:k])
    v = np.linalg.lstsq(c, a, rcond=None)[0] if n > d else None
    if v is not None:
        assert np.abs(c.T @ c / n @ v - v * values[:k]).max() < 1e-7 * values[0]
    return k


def test_rows_against_numpy(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(7)]) for i in range(90)]
    assert check(rows, w.whitened(frame(spark, rows)).collect()) == 7
    assert {x.component for x in w.whitened(frame(spark, rows), most=3).collect()} == {1, 2, 3}
    assert w.whitened(frame(spark, rows)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_constant_columns_and_ties(spark):
    corners = [(i, [float(s * (j == a)) for j in range(4)] + [3.0, 0.0]) for i, (a, s) in enumerate((a, s) for a in range(4) for s in (1, -1))]
    assert check(corners, w.whitened(frame(spark, corners)).collect()) == 4  # one fourfold root, two zeros
    pair = [(1, [0.5, 0.5]), (2, [-0.5, -0.5])]
    assert check(pair, w.whitened(frame(spark, pair)).collect()) == 1


def test_close_eigenvalues(spark):
    rows = [(i, [s * v / 64 for v in (x, y)]) for i, (x, y, s) in enumerate((x, y, s) for x, y in ((10**6, 0), (0, 10**6 + 1)) for s in (1, -1))]
    got = w.whitened(frame(spark, rows)).collect()
    check(rows, got)
    first = {r.vec_id: r.whitened for r in got if r.component == 1}
    assert abs(first[0]) < 1e-12 and abs(first[2]) == pytest.approx(2**0.5, rel=1e-14)


def test_values_of_any_size(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1e15), r.gauss(0, 1e3), r.gauss(0, 1e20)]) for i in range(12)]
    got = w.whitened(frame(spark, rows)).collect()
    assert all(x.deviation is None and x.identity_error < 1e-9 for x in got) and len(got) == 36


def test_awkward_rows(spark):
    r = random.Random(7)
    fine = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(20)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 0.0]), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0]), (96, [1.0] * 5)]
    got = w.whitened(frame(spark, fine + odd)).collect()
    assert check(fine, got) == 3 and len(got) == 60
    double = w.whitened(frame(spark, fine + fine + [(None, fine[0][1])])).collect()
    assert len(double) == 41 * 3 and {x.n for x in double} == {41}
    for rows in ([], odd[:1], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])], [(1, [float("nan")])]):
        none = w.whitened(frame(spark, rows))
        assert none.count() == 0 and none.columns[:2] == ["vec_id", "component"]
    floats = frame(spark, fine).selectExpr("cast(vec_id as string) vec_id", "cast(embedding as array<float>) v")
    assert w.whitened(floats, vector_col="v").schema["vec_id"].dataType.simpleString() == "string"


def test_op13_query(spark):
    rows = [(x.vec_id, [float(c) for c in x.embedding]) for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert check(rows, w.op13_characteristic_polynomial(spark, "/root/testdata/sf0.001").collect()) == 32
