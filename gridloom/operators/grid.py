"""Grid geometry: snapping, blocks, resampling, projection; a cell key is integer arithmetic on coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snap_out(x: str, y: str, cell: float) -> dict[str, Column]:
    """Bounds of a group, moved outwards to the lattice."""
    low = lambda c: F.floor(F.min(c) / cell) * cell
    high = lambda c: F.ceil(F.max(c) / cell) * cell
    return {"x0": low(x), "x1": high(x), "y0": low(y), "y1": high(y)}


def parent(name: str, factor: int) -> Column:
    return F.floor(F.col(name) / factor).cast("long")


def aggregate_blocks(df: DataFrame, value: str, factor: int, strict: bool = False) -> DataFrame:
    """Mean of factor x factor cells; `strict` makes one missing cell a missing block."""
    mean = F.avg(value)
    return df.groupBy(parent("r", factor).alias("pr"), parent("c", factor).alias("pc")).agg((F.when(F.count(value) == factor * factor, mean) if strict else mean).alias(value))


def majority_of_valid(df: DataFrame, valid: Column, wet: Column, factor: int, least_valid: float = 0.75, least_wet: float = 0.5) -> DataFrame:
    share = F.avg(valid.cast("int"))
    return df.groupBy(parent("r", factor).alias("pr"), parent("c", factor).alias("pc")).agg(share.alias("valid_share"), F.when(share >= least_valid, F.avg(F.when(valid, wet.cast("int"))) >= least_wet).alias("water"))


def nearest_onto(target: DataFrame, source: DataFrame, dst: tuple[float, float, float], src: tuple[float, float, float]) -> DataFrame:
    """Source values at the centres of target cells. Grids are (cell, x0, y0), rows growing with y."""
    (cd, xd, yd), (cs, xs, ys) = dst, src
    at = lambda k, d, s: F.floor((F.col(k) * cd + cd / 2 + d - s) / cs).cast("long")
    t = target.withColumns({"_sr": at("r", yd, ys), "_sc": at("c", xd, xs)})
    s = source.withColumnsRenamed({"r": "_sr", "c": "_sc"})
    return t.join(s, ["_sr", "_sc"], "left").drop("_sr", "_sc")


def embed(df: DataFrame, dr: int, dc: int) -> DataFrame:
    return df.withColumns({"r": F.col("r") + dr, "c": F.col("c") + dc})


def union_grid(df: DataFrame) -> DataFrame:
    return df.agg(F.min("c").alias("c0"), F.min("r").alias("r0"), (F.max("c") - F.min("c") + 1).alias("nx"), (F.max("r") - F.min("r") + 1).alias("ny"))


def block_id(x: Column, y: Column, size: float) -> Column:
    return (F.floor(y / size) * 1_000_000 + F.floor(x / size)).cast("long")


def chainage_on(points: DataFrame, key: str, path: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Distance along a polyline of the nearest place on it; of equally near segments the first."""
    segments, base = [], 0.0
    for k, ((x0, y0), (x1, y1)) in enumerate(zip(path, path[1:], strict=False)):
        dx, dy = x1 - x0, y1 - y0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - x0) * dx + (F.col(y) - y0) * dy) / (dx**2 + dy**2)))
        length = math.hypot(dx, dy)
        dist = F.round(F.hypot(F.col(x) - x0 - t * dx, F.col(y) - y0 - t * dy), 9)
        segments.append(F.struct(dist.alias("dist"), F.lit(k).alias("k"), (base + t * length).alias("chain")))
        base += length
    best = F.least(*segments) if len(segments) > 1 else segments[0]
    return points.select(key, best.alias("_b")).select(key, "_b.chain", "_b.dist")


def utm(lon: Column, lat: Column, central_meridian: float) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing on WGS84 by the Krueger series to the fourth order, in column arithmetic."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    p, d = F.radians(lat), F.radians(lon - central_meridian)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * big * x, k0 * big * y


def point_in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the ring's edges as one expression."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 == y1:
            continue
        spans = (F.lit(y0) > y) != (F.lit(y1) > y)
        crossings = crossings + F.when(spans & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return crossings % 2 == 1
