"""Column expressions of the projections, the tile grid and the cluster ids."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_x(lon: Column) -> Column:
    return lon / F.lit(360.0) + F.lit(0.5)


def project_y(lat: Column) -> Column:
    """Spherical Mercator, clamped to the unit square; only the sine counts, so a latitude beyond a pole is mirrored."""
    s = F.sin(lat * F.lit(pi) / F.lit(180.0))
    y = F.lit(0.5) - F.lit(0.25) * F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(pi)
    return F.when(s >= 1, F.lit(0.0)).when(s <= -1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def unproject_x(x: Column) -> Column:
    return (x - F.lit(0.5)) * F.lit(360.0)


def unproject_y(y: Column) -> Column:
    return F.lit(360.0) * F.atan(F.exp((F.lit(180.0) - y * F.lit(360.0)) * F.lit(pi) / F.lit(180.0))) / F.lit(pi) - F.lit(90.0)


def quantise(v: Column, z: Column, t: Column, extent: int) -> Column:
    """Tile units, halves upward."""
    return F.floor(F.lit(float(extent)) * (v * F.pow(F.lit(2.0), z) - t) + F.lit(0.5)).cast("int")


def tiles_of(v: Column, z: int, margin: float) -> Column:
    """Tiles of one axis whose buffered half-open span [t - margin, t + 1 + margin) holds v, in order."""
    at, last = v * float(1 << z), (1 << z) - 1
    lo, hi = F.greatest(F.lit(0), F.floor(at - 1 - margin)), F.least(F.lit(last), F.floor(at + margin))
    some = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(some, lambda t: (at >= t - margin) & (at < t + 1 + margin))


def tile_id(z: Column, x: Column, y: Column) -> Column:
    return ((F.pow(F.lit(2.0), z).cast("long") * y + x) * 32 + z).cast("long")


def cluster_id(origin: Column, z: Column, points: Column) -> Column:
    return F.shiftleft(origin.cast("long"), 5) + z + 1 + points


def origin_index(cluster: Column, points: Column) -> Column:
    return F.shiftright(cluster - points, 5)


def origin_zoom(cluster: Column, points: Column) -> Column:
    return F.pmod(cluster - points, F.lit(32)).cast("int")


def abbreviated(count: Column) -> Column:
    thousands = F.concat(F.floor(count / 1000 + 0.5).cast("string"), F.lit("k"))
    tenths = F.floor(count / 100 + 0.5)
    whole = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit("k"))
    return F.when(count >= 10_000, thousands).when(count >= 1000, whole).otherwise(count.cast("string"))
