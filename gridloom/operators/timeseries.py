"""Node time series: daily medians, date spines, gap filling, gap runs, bounded interpolation, recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, INTERPOLATED, HELD, NONE = 0, 1, 2, 3


def daily_median(obs: DataFrame, node: str, day: str, value: str, least: int = 1) -> DataFrame:
    """Median per node and day, for nodes observed on at least `least` days."""
    d = obs.groupBy(node, day).agg(F.median(value).alias(value))
    return d.withColumn("_n", F.count(value).over(Window.partitionBy(node))).filter(F.col("_n") >= least).drop("_n")


def spine(df: DataFrame, node: str, day: str, first: Column, last: Column) -> DataFrame:
    """One row per node and day from first to last; values are NULL where there was none."""
    days = F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day)
    return df.select(node).distinct().select(node, days).join(df, [node, day], "left")


def fill(df: DataFrame, node: str, day: str, value: str, most_gap: int | None = None) -> DataFrame:
    """Linear between observations, held beyond the first and the last. kind: how a day got its value; gap: days to the nearest observation.

    With `most_gap`, days further than that from any observation get no value.
    """
    back = Window.partitionBy(node).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(node).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    x = df.withColumn("_o", here).withColumns({"_p": F.last("_o", ignorenulls=True).over(back), "_q": F.first("_o", ignorenulls=True).over(ahead)})
    lag, lead = F.datediff(day, "_p.d"), F.datediff("_q.d", day)
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * lag / F.when(lag + lead > 0, lag + lead)
    kind = F.when(F.col(value).isNotNull(), OBSERVED).when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), INTERPOLATED).when(F.col("_p").isNotNull() | F.col("_q").isNotNull(), HELD).otherwise(NONE)
    x = x.withColumns({"kind": kind, "gap": F.coalesce(F.least(lag, lead), F.lit(999)), "filled": F.coalesce(value, line, F.col("_p.v"), F.col("_q.v"))})
    if most_gap is not None:
        far = F.col("gap") > most_gap
        x = x.withColumns({"filled": F.when(~far, F.col("filled")), "kind": F.when(far, NONE).otherwise(F.col("kind"))})
    return x.drop("_o", "_p", "_q")


def fill_limited(value: str, node: str, day: str, limit: int, backward: bool = False) -> Column:
    """The last (or next) value at most `limit` rows away on a dense spine."""
    w = Window.partitionBy(node).orderBy(F.col(day).desc() if backward else F.col(day)).rowsBetween(-limit, 0)
    return F.last(value, ignorenulls=True).over(w)


def runs(df: DataFrame, node: str, day: str, inside: Column) -> DataFrame:
    """Contiguous stretches of rows for which `inside` holds: node, start, stop, n_days."""
    w = Window.partitionBy(node).orderBy(day)
    x = df.withColumn("_in", inside).withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w)).filter("_in")
    return x.groupBy(node, "_run").agg(F.min(day).alias("start"), F.max(day).alias("stop"), F.count("*").alias("n_days")).drop("_run")


def nearest_states(df: DataFrame, keys, day: str, state: Column) -> dict[str, Column]:
    """The nearest non-NULL state strictly before and strictly after each row."""
    w = Window.partitionBy(*keys).orderBy(day)
    return {"before": F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(state, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}


def bounded_interpolation(points: DataFrame, table: DataFrame, x: str, xp: str, fp: str, width: float) -> DataFrame:
    """fp at x by straight lines, NULL outside the table. The table may ascend or descend but not repeat an xp or hold a NULL."""
    bad = table.agg(F.count("*").alias("n"), F.count_distinct(xp).alias("d"), F.count_if(F.col(xp).isNull() | F.isnan(F.col(xp).cast("double"))).alias("z")).first()
    if bad.z or bad.n != bad.d or bad.n < 2:
        raise ValueError("the table needs two or more rows of strictly monotonic, non-null xp")
    w = Window.orderBy(xp)
    s = table.select(F.col(xp).alias("_a"), F.col(fp).alias("_fa"), F.lead(xp).over(w).alias("_b"), F.lead(fp).over(w).alias("_fb")).filter("_b IS NOT NULL")
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    p = points.withColumns({"_cell": F.floor(F.col(x) / width), "_id": F.monotonically_increasing_id()})
    met = p.join(s, (p["_cell"] == s["_cell"]) & (F.col(x) >= F.col("_a")) & (F.col(x) <= F.col("_b")), "left")
    y = F.col("_fa") + (F.col("_fb") - F.col("_fa")) * (F.col(x) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    return met.groupBy("_id", *points.columns).agg(F.min(y).alias(fp)).drop("_id")


def retained(df: DataFrame, keys, day: str, potential: Column, base: Column, low: Column) -> DataFrame:
    """Wetness with memory: wet today if potentially so, or if yesterday was wet on a base cell that is still low. One fold per cell.

    A day's wetness depends on the one before only through `keeps`; so it is wet if some day of the unbroken keeping stretch up to it was potential.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    keeps = F.coalesce(base & low, F.lit(False))
    x = df.withColumns({"_pot": F.coalesce(potential, F.lit(False)), "_keep": keeps}).withColumn("_break", F.sum((~F.col("_keep")).cast("int")).over(w))
    stretch = Window.partitionBy(*keys, "_break").orderBy(day)
    return x.withColumn("wet", F.max("_pot").over(stretch.rowsBetween(Window.unboundedPreceding, 0))).drop("_pot", "_keep", "_break")
