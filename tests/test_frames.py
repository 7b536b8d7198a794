"""Frames, clips and orders with known results, and what they must refuse."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import frames as R
from gridloom.operators import gates as G
from gridloom.operators import joins as J
from gridloom.operators import learning as L
from gridloom.operators.components import star_components
from gridloom.sources import sinks


def test_declared_datums(spark):
    d = lambda *x: spark.createDataFrame([(v,) for v in x], "datum string")
    assert R.require_same_frame(d("EVRF2019", "evrf 2019", "EVRF-2019")) == "EVRF2019"
    for bad in (("EVRF2019", None), ("EVRF2019", "EGM2008"), ("EVRF2019", " ")):
        with pytest.raises(ValueError, match="datums"):
            R.require_same_frame(d(*bad))


def test_tide_term_of_known_latitudes(spark):
    r = spark.range(1).select(R.free_to_mean(F.lit(0.0)), R.free_to_mean(F.lit(90.0)), R.free_to_mean(F.lit(46.6))).first()
    assert tuple(r) == pytest.approx((0.06029, -0.120583, 0.06029 - 0.180873 * 0.5279), abs=1e-4)


def test_grids_refuse_degrees_and_tell_what_they_miss(spark):
    with pytest.raises(ValueError, match="degrees"):
        R.grid_of(spark.createDataFrame([(33.0, 46.0), (34.0, 47.0)], "x double, y double"), 20.0)
    points = spark.createDataFrame([(1000.0, 2000.0), (1095.0, 2040.0)], "x double, y double")
    g = R.grid_of(points, 20.0).first()
    assert (g.x0, g.y0, g.x1, g.y1, g.nx, g.ny) == (1000, 2000, 1100, 2060, 5, 3)


def test_stages_in_order_and_in_a_cycle(spark):
    e = lambda *x: spark.createDataFrame(list(x), "before string, after string")
    assert {r.node: r.level for r in R.stage_order(e(("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"))).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        R.stage_order(e(("a", "b"), ("b", "c"), ("c", "b")))


def test_salted_join_equals_a_plain_join(spark):
    many = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 11").withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got, want = (x.select("id", "k", "v").orderBy("id").collect() for x in (J.salted_join(many, one, ["k"], "n", 30_000, how), many.join(one, ["k"], how)))
        assert got == want and len(got) > 20_000


def test_star_components_of_a_hub_and_a_path(spark):
    hub = [(0, i) for i in range(1, 12_000)]
    path = [(20_000 + i, 20_001 + i) for i in range(40)]
    got = star_components(spark.createDataFrame(hub + path, "u long, v long"))
    roots = {r.root: r.n for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert roots == {0: 12_000, 20_000: 41}


def test_publish_replaces_a_table_and_leaves_nothing_beside_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.publish(spark.range(5), path)
    assert sinks.publish(spark.range(9), path).count() == 9
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.replace_rows(path, spark.range(8, 12), ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(12))


def test_forest_finds_what_matters_and_is_uncertain_where_it_must_be(spark):
    df = spark.range(600).select((F.col("id") % 20).cast("double").alias("a"), ((F.col("id") * 7919) % 31).cast("double").alias("b"), (F.floor(F.col("id") / 20) % 2).cast("int").alias("frame")).withColumn("y", (F.col("a") > 9).cast("int"))
    assert L.importances(df, ["b", "a"], "y").orderBy("rank").first().feature == "a"
    assert all(r.ap > 0.99 for r in L.transfer(df, ["a", "b"], "y", "frame").collect())
    s = L.surface_classes(df.withColumn("cls", F.when(F.col("a") < 5, 1).when(F.col("a") < 12, 2).otherwise(3)), ["a"], "cls")
    assert s.filter("surface <> cls").count() == 0
    assert L.surface_classes(df.withColumn("cls", (F.col("b") % 3).cast("int")), ["a"], "cls", least=0.9).filter("surface <> 0").count() == 0
    best = L.choose(df, ["a"], "y", "frame", 2, [(3, 1), (5, 2)]).filter("chosen").collect()
    assert len(best) == 1 and best[0].median_ap > 0.99


def test_gates_and_features():
    assert G.kept_features(["TRACE_a", "b", "c_trace"], "^TRACE") == ["b", "c_trace"]


def test_states_on_a_day(spark):
    from gridloom.operators import dedup as U

    df = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 1, "x"), ("b", 3, "x"), ("c", 9, "z"), ("d", 1, None), ("d", 7, "w")], "k string, t int, v string")
    s = U.state_on(df, ["k"], "t", "v", F.lit(4))
    assert {r.k: (r.created, r.existed, r.state, r.same) for r in s.collect()} == {"a": (1, True, "x", False), "b": (1, True, "x", True), "c": (9, False, None, False), "d": (1, True, None, False)}
    with pytest.raises(AssertionError, match="c"):
        U.require_states(s, ["k"])
    with pytest.raises(AssertionError, match="a"):
        U.require_states(s.filter("k <> 'c'"), ["k"], current=True)
    assert U.require_states(s.filter("k = 'b'"), ["k"], current=True).count() == 1


def test_bounded_gates(spark):
    m = spark.createDataFrame([(0, 0.5, None, 3.0)], "a int, b double, c double, d double")
    assert [(r.gate, r.status) for r in G.bounded_gates(m, {"a": 0.0, "b": 0.02, "c": 1.0, "d": None}).collect()] == [("a", "PASS"), ("b", "FAIL"), ("c", "INCOMPLETE"), ("d", "REPORTED")]
