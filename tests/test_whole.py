"""Queries over whole fixtures, held against plain Python on the smallest tables or a whole lattice."""

from collections import defaultdict
from math import pi, sin

import numpy as np
import pytest

from gridloom.plans import catalog, evidence, learning
from gridloom.plans.registry import fixture

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_scene_pairs_of_all_cells_and_months(spark):
    days = defaultdict(set)
    for r in fixture(spark, SF, "sar").collect():
        days[r.orbit, r.r % 4, r.win].add(r.day)
    want = {(o, d): (len(x) * len(days[o, d, "pre"]), (min(x) - max(days[o, d, "pre"])).days) for (o, d, w), x in days.items() if w == "event" and days.get((o, d, "pre"))}
    assert {(r.orbit, r.dir): (r.n_pairs, r.min_gap) for r in run(spark, "join_scene_pairs")} == want


def test_season_partners_of_all_rows(spark):
    days = {r.day for r in fixture(spark, SF, "cell_day").collect()}
    doy = lambda d: d.timetuple().tm_yday
    want = {}
    for a in (d for d in days if d.year == 1996):
        near = [(abs(doy(a) - doy(b)), b) for b in days if b.year == 1995 and abs(doy(a) - doy(b)) <= 12]
        if near:
            want[a] = min(near)[1]
    assert {r.day: r.partner for r in run(spark, "same_season_partner")} == want


def lattice(spark):
    return spark.createDataFrame([(r, c, float((7 * r + 3 * c) % 11)) for r in range(40) for c in range(40)], "r long, c long, dem double")


def test_leaks_between_all_cells(spark):
    at = [(r, c, "train" if c < 18 else "val" if c < 26 else "test") for r in range(40) for c in range(40)]
    want = {(*a, *b) for a in at for b in at if a[2] < b[2] and abs(a[0] - b[0]) < 7 and abs(a[1] - b[1]) < 7}
    got = evidence.split_leaks(lattice(spark)).collect()
    assert want
    assert len(got) == len(want) and {(r.ar, r.ac, r.a_role, r.br, r.bc, r.b_role) for r in got} == want


def test_tiles_blend_over_the_whole_lattice(spark):
    tile = lambda r, c: [(a, b) for a in range(0, 33, 4) for b in range(0, 33, 4) if 0 <= r - a < 8 and 0 <= c - b < 8]
    assert all(tile(r, c) for r in range(40) for c in range(40))
    got = {(r.r, r.c): r.score for r in learning.blended_tiles(lattice(spark)).collect()}
    assert len(got) == 1600
    hann = lambda k: sin(pi * (k + 0.5) / 8) ** 2
    for (r, c), score in got.items():
        w = [hann(r - a) * hann(c - b) for a, b in tile(r, c)]
        assert score == pytest.approx(sum((7 * r + 3 * c) % 11 * x for x in w) / sum(w), abs=1e-5)


def test_convergence_of_every_region(spark):
    areas = defaultdict(list)
    for r in fixture(spark, SF, "draws").collect():
        for m in (10, 20, 40):
            if r.draw <= m:
                areas[m, r.region, r.date].append(float(r.area))
    got = {(r.n_draws, r.region, r.date): (r.p05, r.p50, r.p95) for r in run(spark, "convergence")}
    assert set(got) == set(areas) and len({k[1] for k in got}) == 5
    for k, v in areas.items():
        assert got[k] == pytest.approx(np.quantile(v, (0.05, 0.5, 0.95)), abs=1e-5)
