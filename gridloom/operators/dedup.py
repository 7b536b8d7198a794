"""Best-of-key, mosaics in priority order, ownership; every choice has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordering import wide_median


def best_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_valid_mosaic(df: DataFrame, keys, bands: list[str], priority: list[Column], valid: Column) -> DataFrame:
    """Bands of the first valid source per cell, and how many sources were valid."""
    seen = df.filter(valid).withColumn("_p", F.struct(*priority))
    return seen.groupBy(*keys).agg(F.min_by(F.struct(*bands), "_p").alias("_b"), F.count("*").alias("n_sources")).select(*keys, "_b.*", "n_sources")


def mosaic_seams(df: DataFrame, keys, scene: str, value: str, least: int = 5000) -> DataFrame:
    """Per scene the cells that an earlier one had filled, and the median absolute difference from the mosaic there, NULL where they are no
    more than `least`; the row without a scene is the median over scenes. df: valid cells, one row per cell and scene, taken in order of scene."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(scene))
    earliest = F.min(scene).over(Window.partitionBy(*keys))
    over = df.withColumns({"_d": F.abs(F.col(value) - first), "_first": earliest}).filter(F.col(scene) > F.col("_first"))
    each = wide_median(over, "_d", [scene], out="_m", out_n="n_overlap").select(scene, "n_overlap", F.when(F.col("n_overlap") > least, F.col("_m")).alias("seam"))
    whole = each.agg(F.lit(None).cast(dict(df.dtypes)[scene]).alias(scene), F.sum(F.when(F.col("seam").isNotNull(), F.col("n_overlap"))).alias("n_overlap"), F.median("seam").alias("seam"))
    return each.union(whole)


def state_on(df: DataFrame, keys, stamp: str, payload: str, day) -> DataFrame:
    """Per element: when its first version is from, whether it existed on the day, its state then, and whether that is its last state too."""
    then, now = F.max_by(payload, F.when(F.col(stamp) <= day, F.col(stamp))), F.max_by(payload, stamp)
    got = df.groupBy(*keys).agg(F.min(stamp).alias("created"), F.max(F.col(stamp) <= day).alias("existed"), then.alias("state"), now.alias("_now"))
    return got.withColumn("same", F.col("existed") & F.col("state").eqNullSafe(F.col("_now"))).drop("_now")


def require_states(states: DataFrame, keys, current: bool = False) -> DataFrame:
    """states, unless an element did not exist on the day (or, with `current`, has changed since)."""
    bad = states.filter(~F.col("existed") if not current else ~F.col("same")).select(*keys).limit(5).collect()
    if bad:
        raise AssertionError(f"no such state on the day: {[tuple(r) for r in bad]}")
    return states


def last_paste(df: DataFrame, keys, value: str, order: str, skip_null: bool = False) -> DataFrame:
    """The value pasted last; a NULL pastes over what was there unless `skip_null`."""
    df = df.filter(F.col(value).isNotNull()) if skip_null else df
    return df.groupBy(*keys).agg(F.max_by(F.struct(value), order)[value].alias(value))


def owned_by_first(df: DataFrame, keys, member: str) -> DataFrame:
    """owner: the member of least priority number that covers the cell; owned: whether this row's member is it."""
    w = Window.partitionBy(*keys)
    return df.withColumn("owner", F.min(member).over(w)).withColumn("owned", F.col("owner") == F.col(member))


def physical_cells(x: Column, y: Column, cell: float) -> tuple[Column, Column]:
    """The lattice cell of a coordinate: always floor, since rounding would merge four cells' quarters."""
    return F.floor(x / cell), F.floor(y / cell)


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Rows and distinct keys: equal if no physical cell occurs twice."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(*keys).alias("n_keys"))
