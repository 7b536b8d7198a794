"""Connected inundation: potential water below a surface, a baseline by the same rule, what is new, and its accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_to, label, links
from gridloom.staging import stage


def potential(cells: DataFrame, seed: DataFrame, rule: str = "connected_ceiling", connectivity: int = 8, by=("day",), hand_most: float = 10.0, tile: int = 256) -> DataFrame:
    """Cells below the water surface (columns dem, wse): all, those of low height above drainage, or those connected to the seed.

    Connectivity is judged on the whole mosaic; ownership belongs to the accounting.
    """
    below = cells.filter(F.col("dem") < F.col("wse"))
    if rule == "ceiling_only":
        return below.select(*by, "r", "c")
    if rule == "hand_and_ceiling":
        return below.filter(F.col("hand") <= hand_most).select(*by, "r", "c")
    if rule != "connected_ceiling":
        raise ValueError(f"unknown rule {rule}")
    days = below.select(*by).distinct()
    return connected_to(below, seed.select("r", "c").crossJoin(days), connectivity, by, tile)  # seed cells once per day


def accounting(pot: DataFrame, baseline: DataFrame, cells: DataFrame, zone: str, by: str = "day", area_km2: float = 0.0004, cell_m2: float = 400.0) -> DataFrame:
    """Areas and volumes per day and zone: potential, baseline, new."""
    b = baseline.select("r", "c").distinct().withColumn("base", F.lit(True))
    x = pot.join(cells, [by, "r", "c"]).join(b, ["r", "c"], "left").withColumn("new", F.col("base").isNull())
    depth = F.col("wse") - F.col("dem")
    return x.groupBy(by, zone).agg(
        (F.count("*") * area_km2).alias("potential_km2"), (F.count_if("new") * area_km2).alias("new_km2"),
        (F.sum(depth) * cell_m2 / 1e6).alias("potential_hm3"), (F.sum(F.when(F.col("new"), depth).otherwise(0.0)) * cell_m2 / 1e6).alias("new_hm3"),
    )


def lineage(masks: DataFrame, day: str = "day", tile: int = 256) -> DataFrame:
    """The component of the day before that each component shares most cells with: the first of equal ones."""
    lab = stage(label(masks, 8, [day], tile), "labels")
    k = links(lab, day)
    best = F.max_by(F.struct("prev_comp_r", "prev_comp_c", "cells"), F.struct(F.col("cells"), -F.col("prev_comp_r"), -F.col("prev_comp_c")))
    return k.groupBy(day, "next_comp_r", "next_comp_c").agg(best.alias("b")).select(day, "next_comp_r", "next_comp_c", "b.*")


def connection_level(cells: DataFrame, seed: DataFrame, levels: list[float], connectivity: int = 8, tile: int = 256) -> DataFrame:
    """The lowest level at which a cell is connected to the seed: all levels are labelled together, each as its own mosaic."""
    each = cells.withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    pot = potential(each.withColumn("wse", F.col("level")), seed, by=("level",), connectivity=connectivity, tile=tile)
    return pot.groupBy("r", "c").agg(F.min("level").alias("level"))
