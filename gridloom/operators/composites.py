"""Temporal composites: reductions of a stack over its dates, in which what was not observed never counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.joins import small
from gridloom.operators.ordering import wide_median
from gridloom.staging import stage

KEYS = ("r", "c")


def n_valid(x: Column) -> Column:
    return F.count(x)


def class_mode(df: DataFrame, value: str, keys=KEYS, out: str = "mode") -> DataFrame:
    """The most frequent observed class per cell, the lowest of equally frequent ones, NULL where none was seen; n: observations."""
    seen = df.groupBy(*keys, value).agg(F.count(value).alias("_k"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("_k"), (-F.col(value)).alias("_v"))))
    return seen.groupBy(*keys).agg(best.alias("_b"), F.sum("_k").alias("n")).select(*keys, (-F.col("_b._v")).alias(out), "n")


def percent(condition: Column) -> Column:
    """Share of observed rows in percent, half to even, NULL with none observed."""
    return F.rint(100 * F.avg(condition.cast("double"))).cast("int")


def class_shares(df: DataFrame, value: str, groups: dict[str, tuple[int, ...]], keys=KEYS, not_seen: int = 0) -> DataFrame:
    """Percent of observed dates in each group of classes, with the mode and the count."""
    x = df.withColumn("_x", F.when(F.col(value) != not_seen, F.col(value)))
    shares = x.groupBy(*keys).agg(*(percent(F.col("_x").isin(*codes)).alias(f"share_{k}") for k, codes in groups.items()))
    return shares.join(class_mode(x.withColumnRenamed("_x", "_cls").drop(value), "_cls", keys), list(keys))


def extreme(high: Column, low: Column) -> Column:
    """The signed change furthest from 0; of equal ones the upper."""
    return F.when(F.abs(F.coalesce(high, F.lit(0.0))) >= F.abs(F.coalesce(low, F.lit(0.0))), high).otherwise(low)


def window_composite(df: DataFrame, indices: list[str], window: str = "win", valid: str = "valid", keys=KEYS, windows=("pre", "event", "trace"), negated: tuple[str, str] | None = ("ndmi", "ndbi")) -> DataFrame:
    """Median, minimum and maximum of each index in each window, observation counts, and changes against the first window.

    One groupBy makes all of it. The negated index swaps minimum and maximum. Its memory is what exact medians need: a cell's rows.
    """
    first, middle, last = windows
    within = lambda x, w: F.when((F.col(window) == w) & F.col(valid), F.col(x))
    aggs = [F.count_if((F.col(window) == w) & F.col(valid)).alias(f"n_obs_{w}") for w in windows]
    for i in indices:
        for w in windows:
            aggs.append(F.median(within(i, w)).alias(f"{i}_{w}_med"))
            if w != last:
                aggs += [F.min(within(i, w)).alias(f"{i}_{w}_min"), F.max(within(i, w)).alias(f"{i}_{w}_max")]
    out = df.groupBy(*keys).agg(*aggs)
    names = list(indices)
    if negated:
        src, new = negated
        out = out.withColumns({f"{new}_{w}_med": -F.col(f"{src}_{w}_med") for w in windows})
        out = out.withColumns({f"{new}_{w}_min": -F.col(f"{src}_{w}_max") for w in (first, middle)} | {f"{new}_{w}_max": -F.col(f"{src}_{w}_min") for w in (first, middle)})
        names.append(new)
    change = {}
    for i in names:
        base = F.col(f"{i}_{first}_med")
        change[f"{i}_d_med"] = F.col(f"{i}_{middle}_med") - base
        change[f"{i}_d_ext"] = extreme(F.col(f"{i}_{middle}_max") - base, F.col(f"{i}_{middle}_min") - base)
        change[f"{i}_d_trace"] = F.col(f"{i}_{last}_med") - base
    return out.withColumns(change)


def distinct_date_count(df: DataFrame, date: str, valid: Column, keys=KEYS, out: str = "n_dates") -> DataFrame:
    """Dates on which a cell was seen at least once."""
    return df.groupBy(*keys).agg(F.count_distinct(F.when(valid, F.col(date))).alias(out))


def robust_baseline(df: DataFrame, value: str, keys, floor: float = 0.1) -> DataFrame:
    """Median, median absolute deviation (at least `floor`) and count per group, in two passes."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"), F.count(value).alias("n"))
    dev = df.join(med, list(keys)).groupBy(*keys, "med", "n").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("_mad"))
    return dev.select(*keys, "med", "n", F.greatest("_mad", F.lit(floor)).alias("mad"))


def wide_baseline(df: DataFrame, value: str, keys=(), weight: str | None = None) -> DataFrame:
    """robust_baseline without a floor for few, large groups: its medians are found by ranges of the order, so no task holds a group.

    Only distinct values and their counts are handled. weight: a column of counts, if df has them already.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(value).alias("_x")).agg((F.sum(weight) if weight else F.count("*")).alias("_w"))
    med = wide_median(counted, "_x", keys, "_w")
    if not keys:
        counted, med, keys = counted.withColumn("_one", F.lit(0)), med.withColumn("_one", F.lit(0)), ["_one"]
    m = med.select(*(F.col(k).alias(f"_m_{i}") for i, k in enumerate(keys)), F.col("med").alias("_m"))
    dev = counted.join(m, [F.col(k).eqNullSafe(F.col(f"_m_{i}")) for i, k in enumerate(keys)]).select(*keys, F.abs(F.col("_x") - F.col("_m")).alias("_d"), "_w")
    mad = wide_median(dev, "_d", keys, "_w", "mad", "_n").drop("_n").alias("d")
    both = med.alias("m").join(mad, [F.col(f"m.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])
    return both.select(*(F.col(f"m.{k}") for k in keys if k != "_one"), "med", "n", "mad")


def nmad(df: DataFrame, value: str, keys=(), scale: float = 1.4826) -> DataFrame:
    return wide_baseline(df, value, keys).select(*keys, "med", "n", (F.col("mad") * scale).alias("nmad"))


def robust_z(df: DataFrame, value: str, keys, out: str = "z") -> DataFrame:
    """(median - x) / (1.4826 MAD) per row, 0 where the spread is 0 or undefined. The groups' figures are broadcast if they were counted as few."""
    base = wide_baseline(df, value, keys).select(*keys, F.col("med").alias("_m"), (F.col("mad") * 1.4826).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("_m") - F.col(value)) / F.col("_s")).otherwise(F.lit(0.0))
    return df.join(small(stage(base, "baseline")), list(keys)).withColumn(out, z).drop("_m", "_s")


def leave_one_out(df: DataFrame, value: str, keys, item: str) -> DataFrame:
    """Median and MAD of every group without one of its items, for each item: (item, group, med, mad, n).

    Equal values of an item are counted before they are repeated for the other items.
    """
    a = df.select(*keys, F.col(item).alias("held")).distinct()
    counted = df.groupBy(*keys, item, value).agg(F.count("*").alias("_c"))
    pairs = small(stage(a, "items")).join(counted, list(keys)).filter(F.col(item) != F.col("held"))
    return wide_baseline(pairs, value, [*keys, "held"], "_c")


def histogram(df: DataFrame, value: str, edges: list[float], keys=()) -> DataFrame:
    """Counts per bin, closed on the left, the last also on the right; rows outside are left out."""
    n = len(edges) - 1
    x = F.col(value)
    at = F.when(x == edges[-1], n - 1).otherwise(sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)))
    inside = df.filter((x >= edges[0]) & (x <= edges[-1])).withColumn("bin", at.cast("int"))
    return inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def quantile_from_histogram(hist: DataFrame, edges: list[float], p: float, keys=()) -> DataFrame:
    """Linear interpolation of the cumulative counts inside the bin that reaches p."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("bin")
    h = hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys, F.lit(0))))
    lo = F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("bin") + 1)
    hi = F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("bin") + 2)
    at = lo + (hi - lo) * (p * F.col("_all") - (F.col("_cum") - F.col("n"))) / F.col("n")
    return h.filter(F.col("_cum") >= p * F.col("_all")).groupBy(*keys).agg(F.min_by(at, F.col("bin")).alias("q"))
