"""Frames of reference: vertical datums, lattices and their clips, sections across a path, buffers of blocks, ordering of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import neighbours
from gridloom.staging import stage

# The conventions' permanent tide, mean-tide minus tide-free crust in metres: constant term and factor of the squared sine of latitude.
TIDE_CONSTANT, TIDE_FACTOR = 0.06029, -0.180873


def free_to_mean(latitude: Column) -> Column:
    """What a tide-free height gains in the mean-tide system, by latitude in degrees."""
    s = F.sin(F.radians(latitude))
    return TIDE_CONSTANT + TIDE_FACTOR * s * s


def datum_name(datum: Column) -> Column:
    """A declared vertical datum without spaces, dashes, underscores and case; NULL where nothing is declared."""
    return F.nullif(F.upper(F.regexp_replace(datum, r"[\s_-]+", "")), F.lit(""))


def vertical_frames(inputs: DataFrame, by, datum: str = "datum") -> DataFrame:
    """Per group: the common datum, inputs that declare none, and whether all declare the same."""
    name = datum_name(F.col(datum))
    g = inputs.groupBy(*by).agg(F.count("*").alias("_n"), F.count(name).alias("_d"), F.min(name).alias("_a"), F.max(name).alias("_b"))
    same = (F.col("_n") == F.col("_d")) & (F.col("_a") == F.col("_b"))
    return g.select(*by, F.when(same, F.col("_a")).alias("frame"), (F.col("_n") - F.col("_d")).alias("undeclared"), F.coalesce(same, F.lit(False)).alias("same"))


def require_same_frame(inputs: DataFrame, datum: str = "datum") -> str:
    """The common datum of all inputs, or an error."""
    r = vertical_frames(inputs, [], datum).first()
    if not r.same:
        raise ValueError(f"vertical datums differ or are missing ({r.undeclared} undeclared)")
    return r.frame


def crs_status(crs: Column, wanted: str) -> Column:
    """'ok', or why lengths and areas must not be measured in this reference system."""
    return F.when(crs.isNull() | (F.trim(crs) == ""), "missing").when(F.upper(crs).contains("4326"), "geographic").when(F.upper(F.trim(crs)) == wanted.upper(), "ok").otherwise("other")


def grid_of(points: DataFrame, cell: float, by=(), x: str = "x", y: str = "y") -> DataFrame:
    """The lattice that holds all points of a group: origin, far corner and size, snapped outwards; refused if the bounds look like degrees."""
    b = points.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    if b.filter((F.abs("_x0") <= 180) & (F.abs("_x1") <= 180) & (F.abs("_y0") <= 90) & (F.abs("_y1") <= 90)).limit(1).count():
        raise ValueError("bounds look like degrees; project them first")
    low, high = lambda c: F.floor(F.col(c) / cell) * cell, lambda c: (F.floor(F.col(c) / cell) + 1) * cell
    g = b.select(*by, low("_x0").alias("x0"), low("_y0").alias("y0"), high("_x1").alias("x1"), high("_y1").alias("y1"))
    return g.withColumns({"nx": F.round((F.col("x1") - F.col("x0")) / cell).cast("long"), "ny": F.round((F.col("y1") - F.col("y0")) / cell).cast("long")})


def shortfall(grids: DataFrame, points: DataFrame, by, x: str = "x", y: str = "y") -> DataFrame:
    """How far each grid (x0, y0, x1, y1) falls short of the points that it claims to hold, per side; covered if nowhere."""
    b = points.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    gap = lambda d: F.greatest(d, F.lit(0.0))
    s = grids.join(b, list(by)).select(*by, gap(F.col("x0") - F.col("_x0")).alias("west"), gap(F.col("_x1") - F.col("x1")).alias("east"), gap(F.col("y0") - F.col("_y0")).alias("south"), gap(F.col("_y1") - F.col("y1")).alias("north"))
    return s.withColumn("covered", F.greatest("west", "east", "south", "north") == 0)


def aligned(x0: Column, y1: Column, origin_x: Column, origin_y: Column, cell: float) -> Column:
    """Whether two origins are a whole number of cells apart in both directions."""
    off = lambda a, b: F.abs((a - b) / cell - F.round((a - b) / cell)) < 1e-9
    return off(x0, origin_x) & off(origin_y, y1)


def coarse_clip(frames: DataFrame, cell: float) -> DataFrame:
    """The clip of the lattice of twice the cell that covers each frame (x0, y0, x1, y1), and by how many fine cells it starts before it."""
    wide = 2 * cell
    f = frames.withColumns({"cx0": F.floor(F.col("x0") / wide) * wide, "cy1": F.ceil(F.col("y1") / wide) * wide, "cx1": F.ceil(F.col("x1") / wide) * wide, "cy0": F.floor(F.col("y0") / wide) * wide})
    size = lambda a, b: F.round((F.col(a) - F.col(b)) / wide).cast("long")
    phase = lambda d: F.pmod(F.round(d / cell).cast("long"), F.lit(2))
    return f.withColumns({"nx": size("cx1", "cx0"), "ny": size("cy1", "cy0"), "phase_cols": phase(F.col("x0") - F.col("cx0")), "phase_rows": phase(F.col("cy1") - F.col("y1"))})


def cross_sections(points: DataFrame, levels: list[float], step: float, section: str = "section", k: str = "k", z: str = "z") -> DataFrame:
    """Width and area of the part of each section that is below a level and joined to its middle (k = 0). A missing height ends it."""
    x = points.select(section, k, z).withColumn("level", F.explode(F.array(*(F.lit(float(h)) for h in levels))))
    wall = ~F.coalesce(F.col(z) < F.col("level"), F.lit(False))
    ends = x.groupBy(section, "level").agg(F.max(F.when(wall & (F.col(k) <= 0), F.col(k))).alias("_l"), F.min(F.when(wall & (F.col(k) >= 0), F.col(k))).alias("_r"))
    inside = (F.col("_l").isNull() | (F.col(k) > F.col("_l"))) & (F.col("_r").isNull() | (F.col(k) < F.col("_r"))) & ~F.coalesce(F.col("_l") == 0, F.lit(False))
    depth = F.when(inside, F.col("level") - F.col(z)).otherwise(0.0)
    return x.join(ends, [section, "level"]).groupBy(section, "level").agg((F.count_if(inside) * step).alias("width"), (F.sum(depth) * step).alias("area"))


def buffered_roles(cells: DataFrame, role: str, far: int, buffer_role: int) -> DataFrame:
    """Cells with their role, or buffer_role where a cell of another role is within `far` cells in either direction (a square: corners count).
    Beyond the canvas nothing counts as another role. Rows first, then columns: 2 * (2 * far + 1) copies of a cell, not the square of it."""
    steps = range(-far, far + 1)
    x = cells.select("r", "c", F.col(role).alias("_lo"), F.col(role).alias("_hi"))
    for offsets in ([(0, i) for i in steps], [(i, 0) for i in steps]):
        x = neighbours(x, offsets).groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return cells.join(x, ["r", "c"]).withColumn("final", F.when(F.col("_lo") == F.col("_hi"), F.col(role)).otherwise(buffer_role)).drop("_lo", "_hi")


def stage_order(edges: DataFrame) -> DataFrame:
    """node, level: the longest chain of inputs before each node of `edges` (before, after). A cycle raises. One pass per level."""
    e = stage(edges.select("before", "after").distinct(), "edges")
    left = e.select(F.col("before").alias("node")).union(e.select("after")).distinct()
    done, level = None, 0
    while left.limit(1).count():
        ready = left.join(e.select(F.col("after").alias("node")), "node", "left_anti")
        now = stage(ready.withColumn("level", F.lit(level)), "level")
        if not now.limit(1).count():
            raise ValueError("the stages form a cycle")
        done = now if done is None else done.unionByName(now)
        left = stage(left.join(now, "node", "left_anti"), "left")
        e = stage(e.join(now.select(F.col("node").alias("before")), "before", "left_anti"), "edges")
        level += 1
    return done
