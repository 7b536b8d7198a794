"""Ranks, running values and exact medians over one order of all rows, without a window or a task that holds them all.

Rows are cut into ranges of the order and written with their place, so neither a second read nor a lost executor can move a row to
another range. What ranges tell one another is one row per range (and group), however many rows a range has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.staging import stage

_BITS = 33  # of monotonically_increasing_id: the partition is above them, the place within it below


def in_ranges(df: DataFrame, order: list[str | Column], name: str = "ranges") -> DataFrame:
    """df staged in the given order, with _range and _at, the place of a row within its range from 0.

    Rows that are equal in all of `order` share a range, so end it with a column that tells rows apart.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stage(placed, name).withColumns({"_range": F.shiftright("_at", _BITS).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))})


def ranked_globally(df: DataFrame, order: list[str | Column], out: str = "rank") -> DataFrame:
    """The place of each row in the whole order, from 1, as row_number() without a partition gives it."""
    rows = in_ranges(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row per range
    return rows.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def last_seen(df: DataFrame, order: list[str | Column], value: str, out: str) -> DataFrame:
    """The last non-null `value` at or before each row of the whole order."""
    rows = in_ranges(df, order)
    ends = rows.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end"))
    carry = ends.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last(value, ignorenulls=True).over(w))
    return own.join(F.broadcast(carry), "_range").withColumn(out, F.coalesce("_own", "_carry")).drop("_range", "_at", "_own", "_carry")


def wide_median(df: DataFrame, value: str, keys, weight: str | None = None, out: str = "med", out_n: str = "n") -> DataFrame:
    """Exact median and count of the non-null values per group, for groups of any size; weight: a column of counts. Key columns that are null
    form a group; a group without any value has a NULL median and n 0.

    Equal values are counted first, then ordered in ranges. A piece is a group's share of a range: the counts of pieces tell which one or
    two of them hold the middle, and only the rows of those are numbered.
    """
    keys = list(keys)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    n = F.sum(weight) if weight else F.count("*")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(n.alias("_n"))
    rows = in_ranges(counted, [*keys, "_v"], "medians")
    run = Window.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    pieces = rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_k"))
    pieces = pieces.withColumns({"_before": F.sum("_k").over(run) - F.col("_k"), "_all": F.sum("_k").over(Window.partitionBy(*keys, F.lit(0)))})
    pieces = pieces.withColumns({"_lo": F.floor((F.col("_all") - 1) / 2), "_hi": F.floor(F.col("_all") / 2)})
    middle = pieces.filter((F.col("_lo") < F.col("_before") + F.col("_k")) & (F.col("_hi") >= F.col("_before")))
    met = rows.alias("r").join(middle.alias("p"), [F.col("r._range") == F.col("p._range"), *same("r", "p")]).select(*(F.col(f"r.{k}") for k in keys), "r._range", "_v", "_n", "_before", "_all", "_lo", "_hi")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    holds = lambda place: (F.col(place) < F.col("_upto")) & (F.col(place) >= F.col("_upto") - F.col("_n"))
    found = met.withColumn("_upto", upto).groupBy(*keys).agg(F.max(F.when(holds("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_hi"), F.col("_v"))).alias("_b"), F.max("_all").alias("_all"))
    result = [((F.col("_a") + F.col("_b")) / 2).alias(out), F.coalesce("_all", F.lit(0)).cast("long").alias(out_n)]
    if not keys:
        return found.select(*result)
    return df.select(*keys).distinct().alias("g").join(found.alias("f"), same("g", "f"), "left").select(*(F.col(f"g.{k}") for k in keys), *result)


def file_pieces(df: DataFrame, parts: int, least: int, out: str = "_piece") -> DataFrame:
    """df's rows, read from files, with file_path, row_index and the piece that each is in: consecutive rows of all files in the order of their
    names, the parts-th part of them or `least` rows to a piece, whichever is more. What is counted and numbered is a row per file."""
    rows = df.select("*", "_metadata.file_path", "_metadata.row_index")
    files = rows.groupBy("file_path").agg(F.count("*").alias("_n"))
    files = files.select(F.col("file_path").alias("_file"), (F.sum("_n").over(Window.orderBy("file_path")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    size = F.greatest(F.ceil(F.col("_all") / parts), F.lit(least))
    met = rows.join(F.broadcast(files), F.col("file_path") == F.col("_file"))  # a row per file
    return met.withColumn(out, F.floor((F.col("_before") + F.col("row_index")) / size)).drop("_file", "_before", "_all")


def mean_in_order(df: DataFrame, value: str, keys, order: list[str], out: str = "mean", piece: str | None = None) -> DataFrame:
    """Mean of each group, its values added one after the other in an order of its own: the same double however the rows are dealt over tasks.

    With a piece, the values of each piece are added up, then the pieces' sums in order. A group's values, or those of a piece, must fit one task,
    so it is meant for the groups whose mean lies at a threshold.
    """
    by = [*keys, *([piece] if piece else [])]
    v = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_x")))).alias("_v"))
    s = v.select(*by, F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["_x"]).alias("_s"), F.size("_v").cast("long").alias("_n"))
    if piece:
        s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(piece, "_s"))).alias("_v"), F.sum("_n").alias("_n"))
        s = s.select(*keys, F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["_s"]).alias("_s"), "_n")
    return s.select(*keys, (F.col("_s") / F.col("_n")).alias(out))
