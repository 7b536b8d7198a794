"""Evidence bookkeeping: what was seen by whom, how far two sources agree, and which components or cells a rule concerns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.decisions import last_wins, true
from gridloom.operators.joins import neighbours, small
from gridloom.operators.morphology import dilate
from gridloom.schema import INDEX_SCALE


def corrected_ground(cells: DataFrame, biases: DataFrame, source: str, ground: str = "dem", bias: str = "bias") -> DataFrame:
    """Heights less the bias of their terrain source; a source without an entry stays as it is. biases: one row per source."""
    return cells.join(small(biases), source, "left").withColumn(ground, F.col(ground) - F.coalesce(F.col(bias), F.lit(0.0))).drop(bias)


def standardised(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """Per column x: z_x = (x - median) / interquartile range, clipped, 0 where x is NULL, and has_x. A range under 1e-6 counts as 1.

    Percentiles are exact over all rows. They hold a count per distinct value, so columns should be in stored units (16 bits).
    """
    figures = df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns)).first()  # one row
    out = df
    for c in columns:
        low, mid, high = figures[c] or (0.0, 0.0, 1.0)
        spread = 1.0 if high - low < 1e-6 else high - low
        z = F.least(F.greatest((F.col(c) - mid) / spread, F.lit(-limit)), F.lit(limit))
        # least and greatest skip NULLs, so absence is asked for.
        out = out.withColumns({f"z_{c}": F.when(F.col(c).isNull(), 0.0).otherwise(z), f"has_{c}": F.col(c).isNotNull().cast("int")})
    return out


def one_hot(value: str, classes: dict[str, int]) -> dict[str, Column]:
    return {name: F.coalesce((F.col(value) == k).cast("int"), F.lit(0)) for name, k in classes.items()}


def level_tables(cells: DataFrame, factor: int, levels: list[float], cell_m2: float, ground: str = "dem") -> DataFrame:
    """Wet area and volume of every block of factor x factor cells under each level, from one aggregation of the cells."""
    block = [F.floor(F.col(k) / factor).alias(f"block_{k}") for k in ("r", "c")]
    z = F.col(ground)
    sums = [f(z, h).alias(f"{n}{i}") for i, h in enumerate(levels) for n, f in (("a", lambda z, h: F.count_if(z < h)), ("v", lambda z, h: F.sum(F.when(z < h, h - z).otherwise(0.0))))]
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("level"), (F.col(f"a{i}") * cell_m2).alias("area"), (F.col(f"v{i}") * cell_m2).alias("volume")) for i, h in enumerate(levels))))
    return cells.groupBy(*block).agg(*sums).select("block_r", "block_c", rows.alias("t")).select("block_r", "block_c", "t.*")


def sensor_status(radar: Column, event: Column, trace: Column) -> Column:
    """0 none, 1 radar alone, 2 event image alone, 3 radar and event, 4 trace image alone, 5 radar and trace; event goes before trace."""
    return F.when(event, F.when(radar, 3).otherwise(2)).when(trace, F.when(radar, 5).otherwise(4)).when(radar, 1).otherwise(0)


def observation_bins(df: DataFrame, count: str, bins: dict[str, tuple[int, int]], keys) -> DataFrame:
    """Cells, and their share in percent, whose count lies in each closed bin; a row per group."""
    inside = {n: F.col(count).between(a, b) for n, (a, b) in bins.items()}
    figures = [f for n, x in inside.items() for f in (F.count_if(x).alias(f"n_{n}"), (100 * F.avg(x.cast("int"))).alias(f"pct_{n}"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *figures)


def label_tier(own: Column, other: Column) -> Column:
    """Confidence of a frame's own label (NULL: not observed) beside an overlapping frame's: 0 not observed, 1 single source,
    2 both negative, 3 both positive, 4 in conflict; a label that is neither 0 nor 1 leaves it at single source."""
    both = lambda a, b: true(own == a) & true(other == b)
    return last_wins([(own.isNotNull(), 1), (both(0, 0), 2), (both(1, 1), 3), (both(0, 1) | both(1, 0), 4)], F.lit(0))


def leaks(footprints: DataFrame, size: int, buffer: int, role: str = "role") -> DataFrame:
    """Pairs of footprints (top-left r, c, of `size` cells) of different roles with at most `buffer` cells between them; must be empty.

    Footprints meet by coarse cells of the reach, so the join is one of equal keys.
    """
    reach = size + buffer
    own = footprints.select("r", "c", F.col(role).alias("role"), F.floor(F.col("r") / reach).alias("gr"), F.floor(F.col("c") / reach).alias("gc"))
    near = neighbours(own, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], "gr", "gc")
    a = near.select(F.col("r").alias("ar"), F.col("c").alias("ac"), F.col("role").alias("a_role"), F.col("nr").alias("gr"), F.col("nc").alias("gc"))
    met = a.join(own, ["gr", "gc"]).filter((F.col("a_role") < F.col("role")) & (F.abs(F.col("ar") - F.col("r")) < reach) & (F.abs(F.col("ac") - F.col("c")) < reach))
    return met.select("ar", "ac", "a_role", F.col("r").alias("br"), F.col("c").alias("bc"), F.col("role").alias("b_role"))


def ring(mask: DataFrame, times: int, by=()) -> DataFrame:
    """The cells within `times` steps (8 neighbours) of the mask that are not in it."""
    return dilate(mask, 8, by, times).join(mask.select(*by, "r", "c"), [*by, "r", "c"], "left_anti")


def inventory(seen: DataFrame, strata: DataFrame, period: str, scene: str) -> DataFrame:
    """Per period and stratum: scenes, first and last, share of the stratum that any scene saw, mean share, best scene (earliest on ties).

    seen: cells (r, c) that a scene saw; strata: each cell's stratum. Scenes that saw nothing of a stratum are not counted for it.
    """
    size = strata.groupBy("stratum").agg(F.count("*").alias("n_cells"))
    met = seen.join(strata, ["r", "c"]).select(period, scene, "stratum", "r", "c").distinct()
    each = met.groupBy(period, "stratum", scene).agg(F.count("*").alias("k"))
    union = met.groupBy(period, "stratum", "r", "c").agg(F.lit(1).alias("_")).groupBy(period, "stratum").agg(F.count("*").alias("any"))
    best = F.min_by(F.struct(F.col(scene).alias("s"), "k"), F.struct(-F.col("k"), F.col(scene)))
    figures = each.groupBy(period, "stratum").agg(F.count("*").alias("n_scenes"), F.min(scene).alias("first"), F.max(scene).alias("last"), F.avg("k").alias("mean"), best.alias("best"))
    out = figures.join(union, [period, "stratum"]).join(size, "stratum")
    share = lambda x: F.col(x) / F.col("n_cells")
    return out.select(period, "stratum", "n_cells", "n_scenes", "first", "last", share("any").alias("share_any"), share("mean").alias("mean_share"), F.col("best.s").alias("best_scene"), share("best.k").alias("best_share"))


def candidate_group(water_before: Column, radar_before: Column, radar_peak: Column, radar_any: Column, connected: Column, wet: Column, moist: Column, seen: Column) -> Column:
    """A: water before; C: new water that is connected and not contradicted; B: wet but apart; D: the rest. NULL counts as no evidence."""
    apart = ~true(connected)
    a = true(water_before >= 0.2) | true(radar_before >= 0.3)
    c = true(radar_peak >= 0.5) & true(radar_before < 0.1) & true(connected) & (true(wet) | ~true(seen))
    b = (true(radar_any >= 0.3) | true(moist)) & apart
    return F.when(a, "A").when(c, "C").when(b, "B").otherwise("D")


def delta(event: Column, before: Column) -> Column:
    """Change of an index between two stored values, in stored units, inside 16 bits."""
    return F.least(F.greatest(event - before, F.lit(-32767)), F.lit(32767)).cast("int")


def delta_sanity(df: DataFrame, value: str, keys) -> DataFrame:
    """Shares of changes at the 16-bit limit and of more than 2 index units, and whether both are as small as they must be."""
    v = F.abs(F.col(value))
    share = lambda x: F.coalesce(F.avg(F.when(F.col(value).isNotNull(), x.cast("int"))), F.lit(0.0))
    out = df.groupBy(*keys).agg(share(v >= 32767).alias("at_limit"), share(v > 2 * INDEX_SCALE).alias("over_two"))
    return out.withColumn("ok", (F.col("at_limit") < 1e-3) & (F.col("over_two") < 1e-2))


def strata_shares(df: DataFrame, strata: dict[str, Column], keys, value: Column) -> DataFrame:
    """Size and mean of a value in strata that may overlap: a row counts in each that holds it."""
    names = F.array_compact(F.array(*(F.when(true(x), F.lit(n)) for n, x in strata.items())))
    return df.withColumn("stratum", F.explode(names)).groupBy(*keys, "stratum").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def capped_by_bounds(df: DataFrame, node: str, day: str, value: str, observed: str, bound: str, most_days: int = 3) -> DataFrame:
    """A filled daily series under censored observations: a bound caps its own day, or stands for it where there is no value; the
    days between the last observation and a bound at most `most_days` later run straight towards the bound."""
    past = Window.partitionBy(node).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(node).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    last = F.last(F.when(F.col(observed).isNotNull(), F.struct(F.col(day).alias("d"), F.col(observed).alias("x"))), ignorenulls=True).over(past)
    event = F.first(F.when(F.col(observed).isNotNull() | F.col(bound).isNotNull(), F.struct(F.col(day).alias("d"), F.col(bound).alias("x"), F.col(observed).isNull().alias("censored"))), ignorenulls=True).over(ahead)
    x = df.withColumns({"_last": last, "_next": event})
    gap, step = F.datediff("_next.d", "_last.d"), F.datediff(F.col(day), "_last.d")
    free = F.col(observed).isNull() & F.col(bound).isNull() & F.col("_last").isNotNull() & true(F.col("_next.censored")) & (gap <= most_days)
    ramp = F.col("_last.x") + (F.col("_next.x") - F.col("_last.x")) * step / gap
    out = F.when(F.col(bound).isNotNull(), F.least(F.col(value), F.col(bound))).when(free, ramp).otherwise(F.col(value))
    return x.withColumn(value, out).drop("_last", "_next")


def component_rule(labelled: DataFrame, figures: dict[str, Column], keep: Column) -> DataFrame:
    """Figures of each component (comp_r, comp_c) with n, its cells; only components that the rule holds for."""
    return labelled.groupBy("comp_r", "comp_c").agg(F.count("*").alias("n"), *(f.alias(k) for k, f in figures.items())).filter(keep)


def class_or_uncertain(probabilities: Column, classes: list[str], least: float) -> Column:
    """The most probable class, the first on ties; UNCERTAIN if its probability is below `least`; NULL without probabilities."""
    top = F.array_max(probabilities)
    name = reduce(lambda acc, k: acc.when(probabilities[k[0]] == top, k[1]), enumerate(classes), F.when(top < least, "UNCERTAIN"))
    return F.when(top.isNotNull(), name)
