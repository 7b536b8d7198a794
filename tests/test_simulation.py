"""Values of fields, worlds, water balances and fits against theory and plain Python."""

import math
from collections import defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import simulation as X

RHO = {"exponential": math.exp(-1), "gaussian": math.exp(-1), "spherical": 0.0}


@pytest.mark.parametrize("model", sorted(RHO))
def test_fields_have_unit_variance_and_the_models_correlation(spark, model):
    f = X.correlated_fields(spark.range(6).withColumnRenamed("id", "draw"), 160, 160, 20.0, [(1.0, 100.0, model)], waves=512).toPandas()
    f = f.sort_values(["draw", "r", "c"])["f"].to_numpy().reshape(6, 160, 160)
    assert math.sqrt((f * f).mean()) == pytest.approx(1, abs=0.03)
    both = ((f[:, :, 5:] * f[:, :, :-5]).mean() + (f[:, 5:] * f[:, :-5]).mean()) / 2
    assert both == pytest.approx(RHO[model], abs=0.05)


def test_fields_do_not_depend_on_partitions_and_add_their_nugget(spark):
    cells = spark.range(400).select((F.col("id") % 2).alias("draw"), F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"))
    one = sorted(map(tuple, X.field_at(cells.coalesce(1), 20.0, [(1.0, 100.0, "exponential"), (2.0, 300.0, "spherical")], nugget=0.2).collect()))
    many = sorted(map(tuple, X.field_at(cells.repartition(7), 20.0, [(1.0, 100.0, "exponential"), (2.0, 300.0, "spherical")], nugget=0.2).collect()))
    assert one == many and len(one) == 400
    with pytest.raises(ValueError, match="unknown model"):
        X.covariance(F.lit(1.0), 1.0, "cubic")


def flood(wet, seeds):
    out, todo = set(), [s for s in seeds if s in wet]
    while todo:
        k = todo.pop()
        if k in out:
            continue
        out.add(k)
        todo += [(k[0] + i, k[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (k[0] + i, k[1] + j) in wet]
    return out


def test_worlds_against_flood_fills(spark):
    """Every world cell by cell: median of its nodes' heights, disturbed ground, flood fill from the seed, union of the days before the event."""
    cells, nodes, nearest = X.synthetic_domain(spark, 24, 30, 7)
    got = {(r.draw, r.day_no, r.zone): r for r in X.worlds(cells, nodes, nearest, 3, 4, batch=2, tile=8).collect()}
    heights = {(r.node, r.draw, r.day_no): r.h_draw for r in X.perturbed_heights(nodes, 3).collect()}
    grid = {(r.r, r.c): r for r in cells.collect()}
    of = defaultdict(set)
    for r in nearest.collect():
        of[r.r, r.c].add(r.node)
    lattice = cells.withColumn("draw", F.explode(F.array(*(F.lit(d).cast("long") for d in range(3))))).select("draw", "r", "c")
    noise = {(r.draw, r.r, r.c): r.f for r in X.field_at(lattice, 20.0, [(1.0, 200.0, "exponential")]).collect()}
    seeds = [k for k, v in grid.items() if v.seed]
    for d in range(3):
        dem = {k: v.dem + (v.sigma * noise[d, *k] if d else 0.0) for k, v in grid.items()}
        old, days = set(), {}
        for day in range(7):
            level = {k: median(heights[n, d, day] for n in of[k]) for k in grid}
            days[day] = (flood({k for k in grid if dem[k] < level[k]}, seeds), level)
            old |= days[day][0] if day < 4 else set()
        for day, (pot, level) in days.items():
            for zone in (0, 1):
                own = [k for k in pot if grid[k].zone == zone]
                new = [k for k in own if k not in old]
                r = got[d, day, zone]
                want = (len(own) * 4e-4, sum(k in old for k in grid if grid[k].zone == zone) * 4e-4, len(new) * 4e-4, sum(level[k] - dem[k] for k in own) * 4e-4, sum(level[k] - dem[k] for k in new) * 4e-4)
                assert (r.potential_km2, r.baseline_km2, r.new_km2, r.potential_hm3, r.new_hm3) == pytest.approx(want, abs=1e-9)
                assert day >= 4 or r.new_km2 == 0
    peak = {d: max(range(7), key=lambda day: got[d, day, 0].potential_hm3 + got[d, day, 1].potential_hm3) for d in range(3)}
    assert set(peak.values()) == {5}


BOX = [(k, h, 1000.0) for k in (0, 1) for h in (0.0, 10.0)]


def network(spark, river, loss, t_end, bed=0.0):
    runs = spark.createDataFrame([(1, 0.05, 1.0, loss)], "run long, roughness double, width_factor double, loss double")
    tables = spark.createDataFrame(BOX, "cell long, level double, area double")
    links = spark.createDataFrame([(-1, 0, bed, 5.0, 50.0), (0, 1, bed, 5.0, 50.0)], "a long, b long, bed double, width double, length double")
    return {r.cell: r for r in X.storage_cells(runs, tables, links, spark.createDataFrame(river, "t double, level double"), t_end).collect()}


def test_storage_cells_fill_to_the_river_and_keep_their_water(spark):
    full = network(spark, [(0.0, 2.0), (1e6, 2.0)], 0.0, 40_000.0)
    for r in full.values():
        assert r.level == pytest.approx(2.0, abs=0.01) and r.volume == pytest.approx(2000.0, rel=0.005) and r.area == 1000.0
    leaky = network(spark, [(0.0, 2.0), (3e4, 0.5), (1e6, 0.5)], 1e-4, 50_000.0)
    assert sum(r.volume for r in leaky.values()) == pytest.approx(leaky[0].let_in - leaky[0].lost, abs=1e-6)
    assert leaky[0].lost > 0 and all(0 <= r.level <= 2.5 for r in leaky.values())
    dry = network(spark, [(0.0, 2.0), (1e6, 2.0)], 0.0, 10_000.0, bed=3.0)  # a sill above the river
    assert all(r.volume == 0 for r in dry.values())


def test_reservoir_against_closed_forms(spark):
    form = "run long, form string, crest double, width double, coefficient double, roughness double, length double, floor double, loss double"
    runs = spark.createDataFrame([(1, "weir", 1.0, 2.0, 1.5, 0.05, 100.0, 0.0, 0.0), (2, "friction", 1.0, 2.0, 1.5, 0.05, 100.0, 0.0, 0.0), (3, "weir", 9.0, 2.0, 1.5, 0.05, 100.0, 0.0, 1e-6)], form)
    table = spark.createDataFrame([(0.0, 1e5), (10.0, 1e5)], "level double, area double")
    river = spark.createDataFrame([(0.0, 3.0), (200 * 3600.0, 3.0)], "t double, level double")
    got = defaultdict(list)
    for r in X.reservoir(runs, table, river).orderBy("run", "t").collect():
        got[r.run].append(r)
    free = 1.5 * 2.0 * 2.0**1.5  # the basin is below the crest: the inflow is constant
    assert got[1][0].flow == pytest.approx(free) and got[1][1].level == pytest.approx(free * 3600 / 1e5, rel=1e-6)
    assert got[2][0].flow == pytest.approx(2.0 * 1.0 ** (5 / 3) * math.sqrt(2.0 / 100) / 0.05)
    for run in (1, 2):
        level = [r.level for r in got[run]]
        assert all(a <= b + 1e-9 for a, b in zip(level, level[1:], strict=False)) and level[-1] == pytest.approx(3.0, abs=1e-3)
    assert all(r.level == 0 for r in got[3])


def test_variogram_fits_recover_their_models():
    h = np.arange(25.0, 3000, 50)
    one = X.fit_variogram(h, 0.3 + 1.2 * (1 - np.exp(-h / 400)), np.ones_like(h))
    assert (one["nugget"], one["sills"][0], one["ranges"][0]) == pytest.approx((0.3, 1.2, 400), rel=0.02)
    ball = np.where(h < 2000, (1 - h / 2000) ** 2 * (1 + h / 4000), 0)
    two = X.fit_variogram(h, 0.5 * (1 - np.exp(-h / 150)) + 2.0 * (1 - ball), np.ones_like(h), ("exponential", "spherical"))
    assert two["loss"] < 1e-3 and sum(two["sills"]) + two["nugget"] == pytest.approx(2.5, rel=0.03) and two["ranges"][1] == pytest.approx(2000, rel=0.1)
    assert X.fit_variogram(h, np.full_like(h, 0.7), np.ones_like(h))["nugget"] == pytest.approx(0.7, rel=0.01)
