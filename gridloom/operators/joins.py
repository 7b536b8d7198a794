"""Joins beyond equality: as-of, nearest, range, radius, neighbour and point joins, each with an equi-join key that bounds it.

Spark plans a bare inequality as a nested loop, so a range meets its points by cell: the coordinate is cut into cells, one side is
repeated into the cells that it reaches, and the exact predicate filters within them. A side is broadcast only after its rows
were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordering import last_seen
from gridloom.staging import release, stage

#: Rows up to which a dimension table is broadcast.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted_join(many: DataFrame, one: DataFrame, on, weight: str, total: int, how: str = "inner", most_hot: int = 10_000, hint: str | None = None) -> DataFrame:
    """many joined with one on equal, non-null keys that are unique in `one`, however many rows of `many` a key has.

    weight: a column of `one`, the rows of `many` that have its key; total: their sum. A key above total / most_hot rows (and above
    10,000) is hot: its row is repeated once per share of that size and its rows of `many` are dealt over the shares. At most most_hot
    keys can be hot, so the list of them, keys and shares alone, is broadcast. hint: a join hint for the main join, where its strategy must
    not change with the size of `one`.
    """
    on = list(on)
    share = max(10_000, -(-total // most_hot))
    parts = F.ceil(F.col(weight) / share).cast("int")
    hot = one.filter(F.col(weight) > share).select(*on, parts.alias("_parts"))
    left = many.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts").cast("long")).cast("int"))).drop("_parts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right.hint(hint) if hint else right, [*on, "_salt"], how).drop("_salt")


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, by=(), direction: str = "backward", inclusive: bool = True, out: str | None = None, out_on: str = "matched") -> DataFrame:
    """For each left row the right row nearest before (or after) it: one union, one sort, one running last value; no range join.

    Equal keys match if `inclusive`. Of several right rows with one key, the largest value is taken. Without `by` the sort is cut into
    ranges, each of which starts from the last value of the ranges before it.
    """
    by = list(by)
    out = out or value
    r = right.groupBy(*by, on).agg(F.max(value).alias("_v"))
    forward = direction == "forward"
    # Sources sort before (inclusive) or after (exclusive) the queries of the same key, in the direction of the scan.
    l2 = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(dict(r.dtypes)["_v"])}).withColumn("_row", F.struct(*left.columns))
    r2 = r.withColumn("_side", F.lit(0 if inclusive else 2)).withColumn("_row", F.lit(None).cast(dict(l2.dtypes)["_row"]))
    names = [*by, on, "_side", "_v", "_row"]
    both = l2.select(names).unionByName(r2.select(names)).withColumn("_m", F.when(F.col("_side") != 1, F.struct(F.col(on).alias("k"), F.col("_v").alias("v"))))
    order = [F.col(on).desc() if forward else F.col(on).asc(), F.col("_side").asc()]
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        done = both.withColumn("_l", F.last("_m", ignorenulls=True).over(w))
    else:  # the hash deals the left rows of one key over ranges
        done = last_seen(both, [*order, F.xxhash64("_row")], "_m", "_l")
    done = done.filter("_side = 1")
    return done.select("_row.*", F.col("_l.k").alias(out_on), F.col("_l.v").alias(out))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, how: str = "inner", closed_right: bool = True) -> DataFrame:
    """Points inside [low, high] (or [low, high)): equi-join on cells of `width`, then the exact test."""
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high) if closed_right else F.col(at) < F.col(high))
    return p.join(r, (p["_cell"] == r["_cell"]) & inside, how).drop("_cell")


def radius_pairs(df: DataFrame, x: str, y: str, radius: float, key: str, by=()) -> DataFrame:
    """Pairs (a, b), a < b by key, of the same `by` group within `radius`: cells of the radius' size meet their neighbours."""
    by = list(by)
    base = df.withColumns({"_cx": F.floor(F.col(x) / radius), "_cy": F.floor(F.col(y) / radius)})
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = base.select(*by, F.struct(*df.columns).alias("a"), "_cx", "_cy").withColumn("_n", near)
    a = a.select(*by, "a", (F.col("_cx") + F.col("_n.i")).alias("_cx"), (F.col("_cy") + F.col("_n.j")).alias("_cy"))
    b = base.select(*by, F.struct(*df.columns).alias("b"), "_cx", "_cy")
    both = a.join(b, [*by, "_cx", "_cy"]).filter(F.col(f"a.{key}") < F.col(f"b.{key}"))
    both = both.withColumn("distance", F.hypot(F.col(f"a.{x}") - F.col(f"b.{x}"), F.col(f"a.{y}") - F.col(f"b.{y}")))
    return both.filter(F.col("distance") <= radius).drop("_cx", "_cy")


def nearest(points: DataFrame, nodes: DataFrame, k: int, radius: float, point_key, node_key: str, x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest nodes within `radius` of each point, ranked from 1; ties go to the smaller node key."""
    keys = list(point_key) if isinstance(point_key, (list, tuple)) else [point_key]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    n = nodes.select(F.col(node_key), F.col(x).alias("_nx"), F.col(y).alias("_ny")).withColumn("_o", near)
    n = n.withColumns({"_cx": F.floor(F.col("_nx") / radius) + F.col("_o.i"), "_cy": F.floor(F.col("_ny") / radius) + F.col("_o.j")}).drop("_o")
    p = points.withColumns({"_cx": F.floor(F.col(x) / radius), "_cy": F.floor(F.col(y) / radius)})
    d = F.hypot(F.col(x) - F.col("_nx"), F.col(y) - F.col("_ny"))
    met = p.join(n, ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= radius)
    w = Window.partitionBy(*keys).orderBy("distance", node_key)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_cx", "_cy", "_nx", "_ny")


def nearest_outwards(points: DataFrame, nodes: DataFrame, radii: list[float], point_key, node_key: str, x: str = "x", y: str = "y") -> DataFrame:
    """The nearest node within the last of the growing `radii`, as nearest() with k = 1: a point meets the nodes of a wider radius only if
    no node lies within the one before. Points without any node are left out."""
    keys = list(point_key) if isinstance(point_key, (list, tuple)) else [point_key]
    found, left = [], points
    for i, radius in enumerate(radii):
        found.append(stage(nearest(left, nodes, 1, radius, keys, node_key, x, y), "nearest"))
        if i + 1 < len(radii):
            rest = stage(left.join(found[-1].select(*keys), keys, "left_anti"), "left")
            if i:
                release(left)
            left = rest
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def neighbours(df: DataFrame, offsets, r: str = "r", c: str = "c", also=()) -> DataFrame:
    """Each row once per offset, with nr, nc: the place of that neighbour."""
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    return df.withColumn("_o", o).withColumns({"nr": F.col(r) + F.col("_o.i"), "nc": F.col(c) + F.col("_o.j")}).drop("_o")


def upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def bilinear(points: DataFrame, cells: DataFrame, x: str, y: str, value: str, point_key, r: str = "r", c: str = "c") -> DataFrame:
    """Value at fractional (y, x) = (row, column) places from the four cells around; NULL where one of them is missing or NULL."""
    keys = list(point_key) if isinstance(point_key, (list, tuple)) else [point_key]
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    p = points.withColumns({"_r0": F.floor(y).cast("int"), "_c0": F.floor(x).cast("int")}).withColumn("_k", corner)
    p = p.withColumns({r: F.col("_r0") + F.col("_k.i"), c: F.col("_c0") + F.col("_k.j")})
    wy = F.when(F.col("_k.i") == 1, F.col(y) - F.col("_r0")).otherwise(1 - (F.col(y) - F.col("_r0")))
    wx = F.when(F.col("_k.j") == 1, F.col(x) - F.col("_c0")).otherwise(1 - (F.col(x) - F.col("_c0")))
    p = p.withColumn("_w", wy * wx).filter("_w > 0")
    met = p.join(cells.select(r, c, F.col(value).alias("_v")), [r, c], "left")
    return met.groupBy(*keys).agg(F.when(F.count("_v") == F.count("*"), F.sum(F.col("_v") * F.col("_w"))).alias(value))
