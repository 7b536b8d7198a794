"""Neighbourhood operators over sparse masks: a mask is the set of its cells, one row each, with any grouping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import neighbours

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))


def structure(connectivity: int):
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    return FOUR if connectivity == 4 else EIGHT


def dilate(mask: DataFrame, connectivity: int = 4, by=(), times: int = 1, ny: int | None = None, nx: int | None = None) -> DataFrame:
    """The mask and the neighbours of its cells, inside the lattice if its size is given."""
    by = list(by)
    out = mask.select(*by, "r", "c").distinct()
    for _ in range(times):
        out = neighbours(out, ((0, 0), *structure(connectivity))).select(*by, F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
        if ny is not None:
            out = out.filter(F.col("r").between(0, ny - 1) & F.col("c").between(0, nx - 1))
    return out


def erode(mask: DataFrame, connectivity: int = 4, by=(), times: int = 1, keep: DataFrame | None = None) -> DataFrame:
    """Cells all of whose neighbours are in the mask; what lies outside the lattice is not. Cells of `keep` stay."""
    by = list(by)
    out = mask.select(*by, "r", "c").distinct()
    need = len(structure(connectivity)) + 1
    for _ in range(times):
        near = neighbours(out, ((0, 0), *structure(connectivity))).select(*by, F.col("nr").alias("r"), F.col("nc").alias("c"))
        out = near.groupBy(*by, "r", "c").agg(F.count("*").alias("_n")).filter(F.col("_n") == need).select(*by, "r", "c")
        if keep is not None:
            out = out.union(keep.select(*by, "r", "c")).distinct()
    return out


def boundary(mask: DataFrame, by=(), ny: int | None = None, nx: int | None = None) -> DataFrame:
    """Cells within one step of the mask's edge, on either side."""
    return dilate(mask, 4, by, 1, ny, nx).join(erode(mask, 4, by), [*by, "r", "c"], "left_anti")


def distance_to(cells: DataFrame, sources: DataFrame, most: float, cell: float = 1.0) -> DataFrame:
    """Euclidean distance of every cell to the nearest source, NULL beyond `most`: sources spread to buckets of that size, so no cell meets them all.

    Within a bucket column-wise minima come first, which leaves at most one source per column and side.
    """
    reach = int(most / cell) + 1
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    s = sources.select(F.col("r").alias("_sr"), F.col("c").alias("_sc")).withColumn("_o", near)
    s = s.select("_sr", "_sc", (F.floor(F.col("_sr") / reach) + F.col("_o.i")).alias("_br"), (F.floor(F.col("_sc") / reach) + F.col("_o.j")).alias("_bc"))
    p = cells.withColumns({"_br": F.floor(F.col("r") / reach), "_bc": F.floor(F.col("c") / reach)})
    # First pass: nearest source of each source column for each cell row of a bucket; second pass: the minimum over columns.
    rows = p.select("_br", "_bc", "r").distinct()
    first = rows.join(s, ["_br", "_bc"]).groupBy("_br", "_bc", "r", "_sc").agg(F.min(F.abs(F.col("r") - F.col("_sr"))).alias("_dr"))
    met = p.join(first, ["_br", "_bc", "r"], "left")
    d = F.min(F.hypot((F.col("c") - F.col("_sc")).cast("double"), F.col("_dr").cast("double"))) * cell
    return met.groupBy(*cells.columns).agg(F.when(d <= most, d).alias("distance"))


def majority(cells: DataFrame, value: str, least: float = 0.5, ny: int | None = None, nx: int | None = None) -> DataFrame:
    """Mean of a 3 x 3 window above `least`; beyond the edge the lattice is mirrored (the edge row repeats)."""
    at = neighbours(cells.select("r", "c"), ((0, 0), *EIGHT))
    if ny is not None:
        at = at.withColumns({"nr": F.greatest(F.least("nr", F.lit(ny - 1)), F.lit(0)), "nc": F.greatest(F.least("nc", F.lit(nx - 1)), F.lit(0))})
    v = cells.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col(value).cast("int").alias("_v"))
    return at.join(v, ["nr", "nc"]).groupBy("r", "c").agg((F.avg("_v") > least).alias(value))


def perimeter(labelled: DataFrame, label: str) -> DataFrame:
    """Edges of each component towards cells outside it."""
    edges = neighbours(labelled.select(label, "r", "c"), FOUR)
    inside = labelled.select(F.col(label).alias("_l"), F.col("r").alias("nr"), F.col("c").alias("nc"))
    out = edges.join(inside, (edges["nr"] == inside["nr"]) & (edges["nc"] == inside["nc"]) & (edges[label] == inside["_l"]), "left_anti")
    return out.groupBy(label).agg(F.count("*").alias("perimeter"))
