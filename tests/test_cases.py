"""Small cases with known results for the raster and time-series operators."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.operators import components as C
from gridloom.operators import composites as K
from gridloom.operators import decisions as D
from gridloom.operators import gates as G
from gridloom.operators import grid as R
from gridloom.operators import indices as I
from gridloom.operators import inundation as W
from gridloom.operators import joins as J
from gridloom.operators import metrics as M
from gridloom.operators import morphology as O
from gridloom.operators import sampling as S
from gridloom.operators import simulation as X
from gridloom.operators import timeseries as T
from gridloom.sources import readers, sinks
from gridloom.staging import shared_dir


def cells(spark, grid):
    return spark.createDataFrame([(r, c) for r, row in enumerate(grid) for c, v in enumerate(row) if v] or [(0, 0)], "r long, c long").filter(F.lit(any(map(any, grid))))


def places(df):
    return {(x.r, x.c) for x in df.collect()}


def test_mode_ignores_the_unseen_and_takes_the_lowest_tie(spark):
    df = spark.createDataFrame([(0, 0, 6), (0, 0, 6), (0, 0, None), (0, 1, None), (0, 2, 3), (0, 2, 7)], "r int, c int, cls int")
    got = {(x.r, x.c): (x["mode"], x.n) for x in K.class_mode(df, "cls").collect()}
    assert got == {(0, 0): (6, 2), (0, 1): (None, 0), (0, 2): (3, 2)}


def test_shares_and_medians_divide_by_what_was_seen(spark):
    df = spark.createDataFrame([(0, True, 1000.0), (0, False, 3000.0), (0, None, None), (1, None, None)], "k int, w boolean, v double")
    got = {x.k: (x.p, x.m) for x in df.groupBy("k").agg(K.percent(F.col("w")).alias("p"), F.median("v").alias("m")).collect()}
    assert got == {0: (50, 2000.0), 1: (None, None)}


def test_scaled_storage_rounds_half_to_even_and_clips(spark):
    df = spark.createDataFrame([(0.00025,), (0.00035,), (9.0,), (-9.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(I.to_scaled(F.col("x"))).collect()] == [2, 4, 32767, -32767, None, None]


def test_decibels(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (0.0,), (-0.01,), (float("nan"),), (1e-12,)], "p double")
    got = [r[0] for r in df.select(I.to_decibel(F.col("p"))).collect()]
    assert got[0] - got[1] == pytest.approx(3.0103, abs=1e-4)
    assert got[2:5] == [None, None, None] and got[5] == pytest.approx(-120)


def test_components(spark):
    diagonal = cells(spark, [[i == j for j in range(4)] for i in range(4)])
    seed = spark.createDataFrame([(0, 0)], "r long, c long")
    assert C.connected_to(diagonal, seed, 8, tile=2).count() == 4
    assert C.connected_to(diagonal, seed, 4, tile=2).count() == 1
    with pytest.raises(ValueError):
        C.connected_to(diagonal, seed, 6)
    strip = cells(spark, [[1] * 6])
    assert C.connected_to(strip, seed, 8, tile=2).count() == 6


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in C.star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and all(got[k] == 500 for k in range(500, 560))


def test_largest_and_seeds_and_links(spark):
    grid = [[1, 1, 0, 0, 1], [0, 0, 0, 0, 1], [1, 0, 1, 0, 0]]
    m = cells(spark, grid)
    assert places(C.largest(m, 4, tile=2)) == {(0, 0), (0, 1)}
    river = spark.createDataFrame([(0, 0)], "r long, c long")
    pond = spark.createDataFrame([(2, 2), (0, 0)], "r long, c long")
    got = {(x.r, x.c): x.cls for x in C.seed_classes(m, pond, river, 4, tile=2).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 4): 0, (1, 4): 0, (2, 0): 0, (2, 2): 2}
    lab = spark.createDataFrame([(0, 0, c, p) for c, p in enumerate([1, 1, 0, 2, 2]) if p] + [(1, 0, c, n) for c, n in enumerate([3, 0, 0, 3, 4]) if n], "day long, r long, c long, comp long")
    assert sorted(tuple(x)[1:] for x in C.links(lab, "day", ("comp",)).collect()) == [(1, 3, 1), (2, 3, 1), (2, 4, 1)]


def test_erosion_and_distance(spark):
    m = cells(spark, [[1] * 5 for _ in range(5)])
    assert places(O.erode(m, 4)) == {(r, c) for r in range(1, 4) for c in range(1, 4)}
    assert O.dilate(spark.createDataFrame([(0, 0)], "r long, c long"), 4, ny=5, nx=5).count() == 3
    d = {(x.r, x.c): x.distance for x in O.distance_to(m, spark.createDataFrame([(0, 0)], "r long, c long"), 3.0).collect()}
    assert d[(0, 0)] == 0 and d[(2, 2)] == pytest.approx(math.sqrt(8)) and d[(0, 3)] == 3 and d[(4, 4)] is None
    assert C.erosion_disconnect(m.filter("r = 2 OR c > 2 OR c < 1"), m.filter("c = 4"), m.filter("c = 0"), tile=3) == 1


def test_interpolation_is_bounded(spark):
    table = spark.createDataFrame([(10.0, 6.95), (12.0, 9.0), (14.0, 12.0)], "xp double, fp double")
    x = spark.createDataFrame([(9.999,), (11.0,), (14.001,), (12.0,)], "x double")
    got = {r.x: r.fp for r in T.bounded_interpolation(x, table, "x", "xp", "fp", 1.0).collect()}
    assert got == {9.999: None, 11.0: pytest.approx(7.975), 14.001: None, 12.0: 9.0}
    with pytest.raises(ValueError):
        T.bounded_interpolation(x, table.union(table), "x", "xp", "fp", 1.0)


def test_gap_fill_kinds(spark):
    days = [date(2024, 1, d) for d in range(1, 8)]
    df = spark.createDataFrame([(1, d, {2: 2.0, 5: 5.0}.get(d.day)) for d in days] + [(2, d, None) for d in days], "node long, day date, h double")
    got = {(r.node, r.day.day): (r.kind, r.gap, r.filled) for r in T.fill(df, "node", "day", "h").collect()}
    assert got[1, 1] == (T.HELD, 1, 2.0) and got[1, 3] == (T.INTERPOLATED, 1, 3.0) and got[1, 7] == (T.HELD, 2, 5.0) and got[2, 1] == (T.NONE, 999, None)
    assert T.fill(df, "node", "day", "h", most_gap=1).filter("node = 1 AND kind = 3").count() == 1


def test_undefined_metrics_are_null_and_misses_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 5, 7), (0, 0, 4)], "tp int, fp int, fn int")
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in M.scores().items())).collect()]
    assert got == [(None, None, None, None), (0.0, 0.0, 0.0, 0.0), (None, 0.0, None, 0.0)]


def test_as_of_both_ways(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 9, "c")], "k int, t int, v string")
    back = {(r.k, r.t): r.v for r in J.as_of(left, right, "t", "v", ["k"]).collect()}
    assert back == {(1, 5): "b", (1, 1): None, (2, 5): None}
    strict = {(r.k, r.t): r.v for r in J.as_of(left, right, "t", "v", ["k"], inclusive=False).collect()}
    assert strict[1, 5] == "a"
    ahead = {(r.k, r.t): r.v for r in J.as_of(left, right, "t", "v", ["k"], direction="forward").collect()}
    assert ahead == {(1, 5): "b", (1, 1): "a", (2, 5): None}


def test_last_line_wins(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    got = [r[0] for r in df.select(D.last_wins([(F.col("x") > 0, "low"), (F.col("x") > 3, "high")], "none")).collect()]
    assert got == ["low", "high", "none"]


def test_greedy_folds_balance(spark):
    b = spark.createDataFrame([(i, max(0, 20 - 3 * i), 100 + i) for i in range(20)], "block long, pos long, n long")
    got = S.greedy_folds(b, 4).join(b, "block").groupBy("fold").agg(F.sum("pos").alias("p"), F.count("*").alias("k")).collect()
    assert len(got) == 4 and max(r.p for r in got) - min(r.p for r in got) <= 20 and max(r.k for r in got) <= 7


def test_potential_rules(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 5.0, 2.0), (0, 0, 1, 3.0, 5.0, 2.0), (0, 0, 2, 1.0, 50.0, 2.0)], "day long, r long, c long, dem double, hand double, wse double")
    seed = spark.createDataFrame([(0, 0)], "r long, c long")
    assert places(W.potential(df, seed)) == {(0, 0)}
    assert places(W.potential(df, seed, "ceiling_only")) == {(0, 0), (0, 2)}
    assert places(W.potential(df, seed, "hand_and_ceiling")) == {(0, 0)}


def test_utm_of_a_known_place(spark):
    e, n = R.utm(F.lit(33.0), F.lit(47.0), 33.0)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert row.e == pytest.approx(500000, abs=1e-3) and row.n == pytest.approx(5205183.0, rel=1e-3)


def test_gates(spark):
    t = G.gate_table(spark, {"a": (spark.range(1).select(F.lit(0.0)), 0.0), "b": (None, 0.0)})
    assert {r.gate: r.status for r in t.collect()} == {"a": "PASS", "b": "INCOMPLETE"}
    with pytest.raises(AssertionError):
        G.require(t)
    with pytest.raises(ValueError):
        G.refuse_columns(spark.range(1).withColumnRenamed("id", "hand_m"), "^hand")


def test_esri_grid_and_tables(spark, tmp_path):
    p = tmp_path / "g.asc"
    p.write_text("ncols 3\nnrows 2\nxllcorner 30\nyllcorner 47\ncellsize 0.5\nNODATA_value -9999\n0.1 0.2 -9999\n0.3 0.4 0.5\n")
    z, head = readers.esri_grid(spark, str(p))
    got = {(r.r, r.c): r.z for r in z.collect()}
    assert head["cellsize"] == 0.5 and got[0, 0] == 0.1 and got[0, 2] is None and got[1, 0] == 0.3
    path = f"{shared_dir(spark)}/t"
    sinks.publish(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    after = sinks.replace_rows(path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_streaming_summary_runs_as_a_stream(spark, tmp_path):
    from gridloom.streaming.windows import daily_summary

    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = daily_summary(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").count() == daily_summary(spark.read.parquet(src)).count()
