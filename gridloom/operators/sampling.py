"""Folds, splits and samples from integer hashes that every engine and every partitioning repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.metrics import lcg
from gridloom.operators.ordering import ranked_globally

#: Blocks that the greedy assignment takes to one process; it is sequential by definition.
MOST_BLOCKS = 1_000_000


def key(*columns: Column, seed: int = 1) -> Column:
    """An integer hash of small non-negative integers."""
    h = F.lit(seed)
    for c in columns:
        h = lcg(F.pmod(h * 31 + c.cast("long"), F.lit(2147483648)))
    return h


def greedy_folds(blocks: DataFrame, folds: int, block: str = "block", pos: str = "pos", n: str = "n") -> DataFrame:
    """Whole blocks to folds, largest first: one with positives to the fold of fewest positives, one without to the fold of fewest cells."""
    if blocks.count() > MOST_BLOCKS:
        raise ValueError("too many blocks for a sequential assignment; coarsen them")
    rows = sorted(blocks.select(block, pos, n).collect(), key=lambda r: (-r[pos], -r[n], r[block]))
    load, cells, out = [0] * folds, [0] * folds, []
    for r in rows:
        k = min(range(folds), key=(lambda i: (load[i], cells[i], i)) if r[pos] > 0 else (lambda i: (cells[i], load[i], i)))
        out.append((r[block], k + 1))
        load[k] += r[pos]
        cells[k] += r[n]
    return blocks.sparkSession.createDataFrame(out, f"{block} {dict(blocks.dtypes)[block]}, fold int")


def accepted_split(blocks: DataFrame, draws: int, share: float, tolerance: float, block: str = "block", pos: str = "pos", n: str = "n") -> DataFrame:
    """The first of `draws` random splits whose test part holds `share` of cells and of positives within `tolerance`: draw, block, test."""
    each = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("draw").orderBy(key(F.col("draw"), F.col(block)), block)
    size = Window.partitionBy("draw")
    each = each.withColumn("test", F.row_number().over(w) <= F.ceil(F.count("*").over(size) * share))
    part = lambda c: F.sum(F.when(F.col("test"), F.col(c)).otherwise(0)) / F.sum(c)
    ok = each.groupBy("draw").agg(part(n).alias("a"), part(pos).alias("b")).filter((F.abs(F.col("a") - share) <= tolerance) & (F.abs(F.col("b") - share) <= tolerance))
    return each.join(F.broadcast(ok.agg(F.min("draw").alias("draw"))), "draw").select("draw", block, "test")  # one row


def inner_folds(df: DataFrame, block: str, folds: int, seed: int = 1) -> DataFrame:
    w = Window.orderBy(key(F.col(block), seed=seed), block)
    return df.select(block).distinct().withColumn("fold", (F.row_number().over(w) - 1) % folds)


def stratified(df: DataFrame, strata, cap: int, order: Column, tie: str) -> DataFrame:
    """At most `cap` rows of each stratum, in hashed order."""
    w = Window.partitionBy(*strata).orderBy(order, tie)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_k")


def uniform(df: DataFrame, n: int, order: Column, tie: str) -> DataFrame:
    return df.orderBy(order, tie).limit(n).orderBy(tie)


def oversample(df: DataFrame, n: int, weight: Column, unit: Column, tie: str) -> DataFrame:
    """n rows without replacement, with chances by weight: the largest of Gumbel keys. unit: a hash on (0, 1)."""
    return df.withColumn("_g", F.log(weight) - F.log(-F.log(unit))).orderBy(F.col("_g").desc(), tie).limit(n).drop("_g")


def latin_hypercube(df: DataFrame, n: int, dimensions: int, id_col: str = "id", seed: int = 1) -> DataFrame:
    """A permutation of n strata per dimension, and a place inside each: columns u0, u1, ..."""
    out = df
    for d in range(dimensions):
        jitter = F.pmod(key(F.col(id_col), seed=seed + 577 * d + 13), F.lit(1024)) / 1024
        ranked = ranked_globally(out, [key(F.col(id_col), seed=seed + 101 * d), F.col(id_col)], "_rank")
        out = ranked.withColumn(f"u{d}", (F.col("_rank") - 1 + jitter) / n).drop("_rank")
    return out


def log_uniform(u: Column, low: float, high: float) -> Column:
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))


def unit(h: Column) -> Column:
    """A hash as a number inside (0, 1)."""
    return (F.pmod(h, F.lit(1 << 20)) + 0.5) / (1 << 20)


def normal(h1: Column, h2: Column) -> Column:
    """A standard normal from two hashes (Box-Muller)."""
    return F.sqrt(-2 * F.log(unit(h1))) * F.cos(2 * F.pi() * unit(h2))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the rational polynomial 26.2.17 of Abramowitz and Stegun; error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    p = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * p
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def hold_out(df: DataFrame, pass_col: str, folds: int) -> DataFrame:
    """scheme, held pass, fold: leave-one-out and k-fold of whole passes."""
    p = df.select(pass_col).distinct().withColumn("_k", F.row_number().over(Window.orderBy(pass_col)) - 1)
    loo = p.select(F.lit("leave_one_out").alias("scheme"), F.col(pass_col), F.col("_k").alias("fold"))
    return loo.union(p.select(F.lit("k_fold"), F.col(pass_col), F.col("_k") % folds))
