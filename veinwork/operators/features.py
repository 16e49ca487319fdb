"""Feature vectors of images from whole band arrays: a row per image, no row per pixel. The bands of an image meet in one shuffle of a row per
band; one Arrow pass makes all features of a batch of images at once."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.folds import draw, normal
from veinwork.operators.raster import BANDS, SMALL

#: The added bands and their two indices.
REDEDGE = ["rededge1", "rededge2", "rededge3", "nir08"]
STATISTICS = ("mean", "std", "p10", "p50", "p90", "iqr")
TEXTURE = ("texture_mean", "texture_p90")
INDICES = (
    "ndvi", "ndmi", "nbr", "nbr2", "mndwi", "bare_soil_index", "dry_bare_soil_index", "nir_swir22_nd", "red_swir16_nd", "swir16_swir22_ratio",
    "nir_swir16_ratio", "red_blue_ratio", "green_red_ratio",
)
BASE_NAMES = [f"{b}_{s}" for b in BANDS for s in STATISTICS + TEXTURE] + [f"{i}_{s}" for i in INDICES for s in STATISTICS]
REDEDGE_NAMES = [f"{b}_refl_{s}" for b in REDEDGE for s in STATISTICS + TEXTURE] + [f"{i}_refl_{s}" for i in ("ndre1", "ndre2") for s in STATISTICS]


def images(df: DataFrame, image: Column, band: Column, values: Column, n: int) -> DataFrame:
    """image_id, bands: the arrays of the n bands (numbered from 0) in order; images that lack a band drop out, of a repeated band one stays."""
    rows = df.select(image.alias("image_id"), band.cast("int").alias("band"), values.cast("array<double>").alias("v")).where(f"band >= 0 and band < {n} and v is not null")
    whole = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("band", "v"))).alias("b"))  # n arrays, n being a constant
    first = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(F.filter("b", lambda x: x["band"] == k), F.lit(0))["v"])
    return whole.select("image_id", first.alias("bands")).where(~F.exists("bands", lambda v: v.isNull()))


def _statistics(v: np.ndarray) -> np.ndarray:
    """[..., 6] along the last axis, of finite values; zeros where there are none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        gaps = np.isnan(v).any()
        quantiles = np.moveaxis((np.nanpercentile if gaps else np.percentile)(v, [10, 25, 50, 75, 90], axis=-1), 0, -1)
        mean, std = (np.nanmean, np.nanstd) if gaps else (np.mean, np.std)
        out = np.stack([mean(v, -1), std(v, -1), quantiles[..., 0], quantiles[..., 2], quantiles[..., 4], quantiles[..., 3] - quantiles[..., 1]], -1)
    return np.nan_to_num(out, nan=0.0)


def _texture(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """[..., 2]: mean and 90th percentile of the steps between neighbours along both axes."""
    grid = v.reshape(*v.shape[:-1], height, width)
    steps = np.concatenate([np.abs(np.diff(grid, axis=a)).reshape(*v.shape[:-1], -1) for a in (-2, -1)], -1)
    if not steps.shape[-1]:
        return np.zeros((*v.shape[:-1], 2))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nan_to_num(np.stack([np.nanmean(steps, -1), np.nanpercentile(steps, 90, axis=-1)], -1), nan=0.0)


def _share(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.divide(a, b, out=np.full_like(a, otherwise), where=np.abs(b) > SMALL)


def base_features(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """[images, 126] of [images, 6, pixels], BASE_NAMES. Values that aren't finite take the median of their band, 0 where it has none."""
    v = np.where(np.isfinite(v), v, np.nan)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        v = np.where(np.isnan(v), np.nan_to_num(np.nanmedian(v, -1), nan=0.0)[..., None], v)
    r, g, b, n, s, t = np.moveaxis(v, 1, 0)
    nd = lambda x, y: _share(x - y, x + y, 0.0)
    ratio = lambda x, y: _share(x, y, 0.0)
    index = [nd(n, r), nd(n, s), nd(n, t), nd(s, t), nd(g, s), nd(s + r, n + b), nd(s, g) - nd(n, r), nd(n, t), nd(r, s), ratio(s, t), ratio(n, s), ratio(r, b), ratio(g, r)]
    bands = np.concatenate([_statistics(v), _texture(v, height, width)], -1)
    return np.concatenate([bands.reshape(len(v), -1), _statistics(np.stack(index, 1)).reshape(len(v), -1)], 1)


def rededge_features(v: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """[images, 44] of [images, 4, pixels], REDEDGE_NAMES, from the pixels that are finite in all four bands; and their share."""
    ok = np.isfinite(v).all(1)
    v = np.where(ok[:, None], v, np.nan)
    e1, e2, e3, n8 = np.moveaxis(v, 1, 0)
    nd = [_share(n8 - e1, n8 + e1, np.nan), _share(e3 - e2, e3 + e2, np.nan)]
    bands = np.concatenate([_statistics(v), _texture(v, height, width)], -1)
    return np.concatenate([bands.reshape(len(v), -1), _statistics(np.stack(nd, 1)).reshape(len(v), -1)], 1), ok.mean(-1)


def _mapped(df: DataFrame, n: int, width: int, names: list[str], make: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """image_id and a column per name, of images(); make turns [images, n, pixels] of one size into [images, names]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                rows, ids = part.column(1).to_pylist(), part.column(0)
                sizes: dict[int, list[int]] = {}
                for i, bands in enumerate(rows):
                    size = len(bands[0])
                    if size and size % width == 0 and all(len(x) == size for x in bands):  # bands of other sizes aren't co-registered
                        sizes.setdefault(size, []).append(i)
                for size, at in sizes.items():
                    values = np.array([[rows[i][k] for k in range(n)] for i in at], dtype=np.float64)
                    out = make(values, size // width, width)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(np.ascontiguousarray(out[:, j]), from_pandas=True) for j in range(out.shape[1]))], names=["image_id", *names])

    kind = dict(df.dtypes)["image_id"]
    return df.select("image_id", "bands").mapInArrow(run, f"image_id {kind}, " + ", ".join(f"{c} double" for c in names))


def base_vectors(df: DataFrame, width: int) -> DataFrame:
    """image_id and the 126 features of images() of the six BANDS; images whose bands differ in size, or that no whole rows make, drop out."""
    return _mapped(df, len(BANDS), width, BASE_NAMES, base_features)


def rededge_vectors(df: DataFrame, width: int, least: float = 0.5) -> DataFrame:
    """image_id, the 44 features of images() of the four REDEDGE bands, coverage. Images of less joint coverage than least, or with a feature that
    no pixel gives, have null features: they are to be abstained from."""

    def make(v: np.ndarray, height: int, width: int) -> np.ndarray:
        out, coverage = rededge_features(v, height, width)
        out[coverage < least] = np.nan
        return np.concatenate([out, coverage[:, None]], 1)

    return _mapped(df, len(REDEDGE), width, [*REDEDGE_NAMES, "coverage"], make)


def appended(df: DataFrame, width: int, least: float = 0.5) -> DataFrame:
    """image_id, 126 and 44 features, coverage, of images() of ten bands: BANDS, then REDEDGE."""

    def make(v: np.ndarray, height: int, width: int) -> np.ndarray:
        out, coverage = rededge_features(v[:, len(BANDS) :], height, width)
        out[coverage < least] = np.nan
        return np.concatenate([base_features(v[:, : len(BANDS)], height, width), out, coverage[:, None]], 1)

    return _mapped(df, len(BANDS) + len(REDEDGE), width, [*BASE_NAMES, *REDEDGE_NAMES, "coverage"], make)


#: What is done to images, and how much.
SCENARIOS = (
    [("baseline", "baseline", 0.0)] + [(f"missing_pixels_{p:g}", "missing_pixels", p) for p in (0.05, 0.10, 0.25, 0.50, 0.75)] + [(f"noise_{p:g}", "noise", p) for p in (0.01, 0.05, 0.10, 0.25)]
    + [(f"band_{i}_missing", "band_missing", float(i)) for i in range(6)] + [(f"brightness_{p:g}", "brightness", p) for p in (0.8, 1.2, 1.5)]
)


def perturbed(df: DataFrame, seed: str = "im") -> DataFrame:
    """image_id, scenario, bands: each image of images() under each of SCENARIOS. Pixels go missing, and noise (in units of the band's deviation) comes, by
    hashes of seed, scenario, image, band and place, so that any engine draws the same; arrays stay arrays."""
    catalog = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("kind"), F.lit(p).alias("p")) for n, k, p in SCENARIOS))
    real = lambda v: F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    # in steps, so that no sum is made anew for each pixel
    known = df.select("image_id", "bands", F.transform("bands", real).alias("__v")).withColumn("__m", F.transform("__v", mean))
    squares = F.transform("__v", lambda v, b: F.transform(v, lambda x: (x - F.get("__m", b)) * (x - F.get("__m", b))))
    rows = known.withColumn("__s", F.transform(squares, lambda v: F.sqrt(mean(v)))).select("image_id", "bands", "__s", F.inline(catalog))

    def one(v: Column, b: Column) -> Column:
        place = lambda i: [F.lit(seed), F.col("scenario"), F.col("image_id").cast("string"), b.cast("string"), i.cast("string")]
        gone = lambda i: draw(*place(i)) / float(1 << 32) < F.col("p")
        return (
            F.when(F.col("kind") == "missing_pixels", F.transform(v, lambda x, i: F.when(~gone(i), x)))
            .when(F.col("kind") == "noise", F.transform(v, lambda x, i: x + normal(*place(i)) * F.get("__s", b) * F.col("p")))
            .when(F.col("kind") == "band_missing", F.transform(v, lambda x: F.when(b != F.col("p").cast("int"), x)))
            .when(F.col("kind") == "brightness", F.transform(v, lambda x: x * F.col("p")))
            .otherwise(v)
        )

    return rows.select("image_id", "scenario", F.transform("bands", one).alias("bands"))


def missing_share(bands: Column) -> Column:
    """The share of values that aren't finite."""
    gone = lambda v: F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return F.aggregate(F.transform(bands, gone), F.lit(0), lambda a, x: a + x) / F.aggregate(F.transform(bands, F.size), F.lit(0), lambda a, x: a + x)
