"""Image feature vectors against plain loops, and images that are odd."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.operators import features as x


def frame(spark, images):
    rows = [(i, k, v) for i, bands in images.items() for k, v in enumerate(bands)]
    return spark.createDataFrame(rows, "image bigint, band int, v array<double>").repartition(3)


def made(spark, images, n, width, make, **more):
    df = x.images(frame(spark, images), F.col("image"), F.col("band"), F.col("v"), n)
    return {r.image_id: r.asDict() for r in make(df, width, **more).collect()}


def stats(v):
    v = np.array([a for a in v if a is not None and math.isfinite(a)])
    if not len(v):
        return [0.0] * 6
    q = np.percentile(v, [10, 25, 50, 75, 90])
    return [v.mean(), v.std(), q[0], q[2], q[4], q[3] - q[1]]


def texture(v, width):
    steps = []
    for i, a in enumerate(v):
        for j in ([i + 1] if (i + 1) % width else []) + ([i + width] if i + width < len(v) else []):
            if a is not None and v[j] is not None:
                steps.append(abs(a - v[j]))
    return [np.mean(steps), np.percentile(steps, 90)] if steps else [0.0, 0.0]


def test_base_features(spark):
    r = random.Random(1)
    images = {k: [[r.uniform(0, 1) for _ in range(12)] for _ in range(6)] for k in range(5)}
    images[3][1][4] = None
    images[3][2][:3] = [float("nan"), float("inf"), None]
    images[4][0] = [None] * 12
    images[7] = [[0.5] * 8 for _ in range(6)]
    got = made(spark, images, 6, 4, x.base_vectors)
    assert set(got) == set(images) and len(x.BASE_NAMES) == 126
    for k, bands in images.items():
        full = []
        for v in bands:
            fine = [a for a in v if a is not None and math.isfinite(a)]
            fill = float(np.median(fine)) if fine else 0.0
            full.append([a if a is not None and math.isfinite(a) else fill for a in v])
        red, green, blue, nir, s16, s22 = full
        nd = lambda p, q: [(a - b) / (a + b) if abs(a + b) > 1e-6 else 0.0 for a, b in zip(p, q)]
        ratio = lambda p, q: [a / b if abs(b) > 1e-6 else 0.0 for a, b in zip(p, q)]
        plus = lambda p, q: [a + b for a, b in zip(p, q)]
        index = [nd(nir, red), nd(nir, s16), nd(nir, s22), nd(s16, s22), nd(green, s16), nd(plus(s16, red), plus(nir, blue)), [a - b for a, b in zip(nd(s16, green), nd(nir, red))], nd(nir, s22), nd(red, s16), ratio(s16, s22), ratio(nir, s16), ratio(red, blue), ratio(green, red)]
        want = [a for v in full for a in stats(v) + texture(v, 4)] + [a for v in index for a in stats(v)]
        assert [got[k][c] for c in x.BASE_NAMES] == pytest.approx(want), k


def test_rededge_features_abstain(spark):
    r = random.Random(2)
    images = {k: [[r.uniform(0.1, 1) for _ in range(16)] for _ in range(4)] for k in range(3)}
    images[1][2][5] = None
    for i in range(9):
        images[2][i % 4][i] = float("nan")
    got = made(spark, images, 4, 4, x.rededge_vectors)
    assert [got[k]["coverage"] for k in range(3)] == [1.0, 15 / 16, 7 / 16] and len(x.REDEDGE_NAMES) == 44
    assert all(got[2][c] is None for c in x.REDEDGE_NAMES)
    for k in (0, 1):
        ok = [all(b[i] is not None for b in images[k]) for i in range(16)]
        kept = [[a if o else None for a, o in zip(b, ok)] for b in images[k]]
        nd = lambda p, q: [(a - b) / (a + b) if a is not None else None for a, b in zip(p, q)]
        want = [a for v in kept for a in stats(v) + texture(v, 4)] + stats(nd(kept[3], kept[0])) + stats(nd(kept[2], kept[1]))
        assert [got[k][c] for c in x.REDEDGE_NAMES] == pytest.approx(want)


def test_ten_bands_in_one_pass(spark):
    r = random.Random(3)
    images = {k: [[r.uniform(0.1, 1) for _ in range(n)] for _ in range(10)] for k, n in ((0, 16), (1, 16), (2, 24), (3, 10), (4, 16))}
    images[4][6:] = [[None] * 16 for _ in range(4)]
    got = made(spark, images, 10, 4, x.appended)
    base = made(spark, {k: v[:6] for k, v in images.items()}, 6, 4, x.base_vectors)
    added = made(spark, {k: v[6:] for k, v in images.items()}, 4, 4, x.rededge_vectors)
    assert set(got) == {0, 1, 2, 4}  # 10 pixels are no whole rows of 4
    for k, row in got.items():
        assert row == pytest.approx({**base[k], **added[k]}) or k == 4 and row["coverage"] == 0 and row["nir08_refl_mean"] is None


def test_images_that_are_not_whole(spark):
    images = {0: [[0.1] * 4] * 6, 1: [[0.1] * 4] * 5, 2: [[0.1] * 4] * 5 + [[0.1] * 6], 3: [[]] * 6, 4: [[0.1] * 4] * 5 + [None], 5: [[0.2] * 4] * 8}
    assert set(made(spark, images, 6, 2, x.base_vectors)) == {0, 5}
    twice = frame(spark, {0: [[0.1] * 4] * 6}).unionByName(frame(spark, {0: [[0.1] * 4] * 6}))
    assert x.base_vectors(x.images(twice, F.col("image"), F.col("band"), F.col("v"), 6), 2).count() == 1
    none = frame(spark, {0: [[0.1] * 4] * 6}).where("1 = 0")
    assert x.base_vectors(x.images(none, F.col("image"), F.col("band"), F.col("v"), 6), 2).count() == 0
