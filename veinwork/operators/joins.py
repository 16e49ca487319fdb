"""Joins with contracts, and joins on the sphere."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.columns import EARTH_KM, haversine_km
from veinwork.sources.scratch import settled

KM_PER_DEGREE = math.pi * EARTH_KM / 180


class ContractError(ValueError):
    """A table breaks a contract that an operator states."""


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_empty(df: DataFrame, what: str) -> None:
    if found := df.limit(5).collect():
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys must be unique on both sides; checked before."""
    assert_empty(violations(left, keys), f"keys {keys} repeat on the left")
    assert_empty(violations(right, keys), f"keys {keys} repeat on the right")
    return left.join(right, keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    assert_empty(violations(right, keys), f"keys {keys} repeat on the right")
    return left.join(right, keys, how)


def unambiguous(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of the keys that are unique on both sides; other keys drop out."""
    single = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    both = single(left).join(single(right), keys, "left_semi")
    return left.join(both, keys, "left_semi").join(right, keys)


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, str], tolerance: float = 1e-6, relative: float = 0.0) -> DataFrame:
    """Equal keys, and each pair of values within tolerance + relative * |right value|."""
    near = reduce(lambda a, b: a & b, (F.abs(F.col(a) - F.col(b)) <= tolerance + relative * F.abs(F.col(b)) for a, b in values.items()))
    return left.join(right, keys).where(near)


def shared_values(left: DataFrame, right: DataFrame, column: str, into: str) -> DataFrame:
    """Flag the left rows whose non-blank value is on the right as well."""
    known = right.where(F.trim(column) != "").select(F.col(column).alias("__v")).distinct().withColumn("__hit", F.lit(True))
    return left.join(known, F.col(column) == F.col("__v"), "left").withColumn(into, F.coalesce("__hit", F.lit(False))).drop("__v", "__hit")


def _grid(lat: Column, lon: Column, degrees: float, columns: int) -> tuple[Column, Column]:
    return F.floor((lat + 90) / degrees).cast("int"), F.floor((lon + 180) / (360 / columns)).cast("int")


def radius_pairs(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", right_lat: str = "r_lat", right_lon: str = "r_lon", degrees: float | None = None) -> DataFrame:
    """All (left, right) rows at most km apart, with distance_km. Cells are about as wide as the radius; a left row looks into the
    cells around its own, as many in longitude as its latitude asks for, around the date line too. Column names of the two
    sides must differ; rows without coordinates meet nothing."""
    d = degrees or max(0.01, min(45.0, km / KM_PER_DEGREE))
    # whole columns around the earth, all of one width of at least d, so that none is narrower at the date line
    columns, reach = int(math.floor(360 / d)), math.ceil(km / KM_PER_DEGREE / d)
    la, lo = _grid(F.col(lat), F.col(lon), d, columns)
    # at the farthest latitude within reach a degree of longitude is shortest
    farthest = F.least(F.lit(89.9), F.abs(F.col(lat)) + km / KM_PER_DEGREE)
    wide = F.when(F.abs(F.col(lat)) + km / KM_PER_DEGREE >= 85, F.lit(columns // 2 + 1)).otherwise(F.ceil(km / (KM_PER_DEGREE * F.cos(F.radians(farthest)) * d)).cast("int"))
    wide = F.least(wide, F.lit(columns // 2 + 1))
    cells = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("__a", F.explode(F.sequence(la - reach, la + reach)))
    steps = F.array_distinct(F.transform(F.sequence(lo - wide, lo + wide), lambda x: F.pmod(x, F.lit(columns))))
    cells = cells.withColumn("__o", F.explode(steps))
    ra, ro = _grid(F.col(right_lat), F.col(right_lon), d, columns)
    at = right.where(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).withColumn("__a", ra).withColumn("__o", F.pmod(ro, F.lit(columns)))
    joined = cells.join(at, ["__a", "__o"]).drop("__a", "__o")
    return joined.withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), F.col(right_lat), F.col(right_lon))).where(F.col("distance_km") <= km)


#: Widths in degrees of the grids that nearest() walks down; the finest is about a kilometre.
GRIDS = [45.0 / 4**i for i in range(7)]


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, lat: str = "lat", lon: str = "lon", right_lat: str = "r_lat", right_lon: str = "r_lon") -> DataFrame:
    """key, right_key, distance_km of each left row's nearest right row, ties to the smallest right key. Places are looked for from
    coarse cells that hold right rows down to fine ones: a cell stays while its nearest point may be closer than another cell's
    farthest one, so every place meets few cells of each grid and few places at the end, however far or dense the right rows are.
    Rows without coordinates meet nothing; rows at one place count once."""
    has = lambda df, y, x: df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    at = lambda d, y, x: [F.least(F.floor((F.col(y) + 90) / d), F.lit(int(180 / d) - 1)).cast("int"), F.least(F.floor((F.col(x) + 180) / d), F.lit(int(360 / d) - 1)).cast("int")]
    cells = lambda d, name: F.array(*at(d, "r_y", "r_x")).alias(name)
    sites = settled(has(right, right_lat, right_lon).groupBy(F.col(right_lat).alias("r_y"), F.col(right_lon).alias("r_x")).agg(F.min(right_key).alias(right_key)), "nearest-right")
    met = has(left, lat, lon).select(F.col(lat).alias("y"), F.col(lon).alias("x")).distinct()
    above = None
    for d in GRIDS:
        level = sites.select(*([cells(above, "__up")] if above else []), cells(d, "__cell")).distinct()
        # the coarsest grid has 32 cells
        pairs = met.join(level, "__up") if above else met.crossJoin(F.broadcast(level))
        middle = haversine_km(F.col("y"), F.col("x"), (F.col("__cell")[0] + 0.5) * d - 90, (F.col("__cell")[1] + 0.5) * d - 180)
        reach = d / 2 * math.sqrt(2) * KM_PER_DEGREE + 1e-6
        pairs = pairs.select("y", "x", "__cell", middle.alias("__mid"))
        met = pairs.withColumn("__best", F.min("__mid").over(Window.partitionBy("y", "x"))).where(F.col("__mid") - reach <= F.col("__best") + reach).select("y", "x", F.col("__cell").alias("__up"))
        above = d
    km = haversine_km(F.col("y"), F.col("x"), F.col("r_y"), F.col("r_x"))
    best = met.join(sites.withColumn("__up", F.array(*at(above, "r_y", "r_x"))), "__up").groupBy("y", "x").agg(F.min(F.struct(km.alias("distance_km"), right_key)).alias("m"))
    return left.join(best, (F.col(lat) == F.col("y")) & (F.col(lon) == F.col("x"))).select(key, f"m.{right_key}", "m.distance_km")


def any_within(left: DataFrame, right: DataFrame, key: str, km: float, **columns: str) -> DataFrame:
    """The left rows with a right row at most km away."""
    return left.join(radius_pairs(left, right, km, **columns).select(key).distinct(), key, "left_semi")


def none_within(left: DataFrame, right: DataFrame, key: str, km: float, **columns: str) -> DataFrame:
    return left.join(radius_pairs(left, right, km, **columns).select(key).distinct(), key, "left_anti")
