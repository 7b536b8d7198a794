"""Ranks, running values and medians over ranges of an order, against plain Python and Spark's own aggregates."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from gridloom.operators import composites as K
from gridloom.operators import joins as J
from gridloom.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, a third of all rows with one value, a null key and a group without values."""
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 5}", 7.0 if i % 3 == 0 else round(rng.uniform(-50, 50), 2), i) for i in range(3000)]
    rows += [(None, 1.0, 3000), (None, 4.0, 3001), ("none", None, 3002), ("one", 2.5, 3003)]
    return spark.createDataFrame(rows, "g string, v double, id long").repartition(7), rows


def test_global_rank(spark, skewed):
    df, rows = skewed
    got = {r.id: r["rank"] for r in O.ranked_globally(df.filter("v IS NOT NULL"), [F.col("v").desc(), F.col("id")]).collect()}
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(want)}
    assert O.ranked_globally(df.limit(0), ["id"]).count() == 0


def test_last_seen_crosses_ranges(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id").isin(3, 2400), F.col("id"))).repartition(9)
    got = [r["l"] for r in O.last_seen(df, ["id"], "v", "l").orderBy("id").collect()]
    assert got == [None] * 3 + [3] * 2397 + [2400] * 2600


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_without_groups_equals_one_group(spark, direction, inclusive):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.randrange(400), i) for i in range(2000)] + [(5, 1)] * 3, "t long, i long").repartition(5)
    right = spark.createDataFrame([(rng.randrange(400), rng.random()) for _ in range(60)], "t long, v double")
    free = J.as_of(left, right, "t", "v", direction=direction, inclusive=inclusive)
    one = J.as_of(left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), "t", "v", ["k"], direction=direction, inclusive=inclusive).drop("k")
    assert sorted(map(repr, free.collect())) == sorted(map(repr, one.collect()))


def test_wide_median(spark, skewed):
    df, rows = skewed
    got = {r.g: (r.med, r.n) for r in O.wide_median(df, "v", ["g"]).collect()}
    values = {g: [r[1] for r in rows if r[0] == g and r[1] is not None] for g in {r[0] for r in rows}}
    assert got == {g: (median(v) if v else None, len(v)) for g, v in values.items()}
    whole = O.wide_median(df, "v", []).collect()
    every = [r[1] for r in rows if r[1] is not None]
    assert [(r.med, r.n) for r in whole] == [(median(every), len(every))]
    assert O.wide_median(df.limit(0), "v", ["g"]).count() == 0


def test_wide_median_of_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 2), ("b", 1.0, 1), ("b", 2.0, 5)], "g string, v double, w long")
    assert {r.g: (r.med, r.n) for r in O.wide_median(df, "v", ["g"], "w").collect()} == {"a": (3.0, 4), "b": (2.0, 6)}


def test_wide_baseline_equals_the_plain_one(spark, skewed):
    df = skewed[0].filter("g IS NOT NULL")
    wide = {r.g: (r.med, r.n, r.mad) for r in K.wide_baseline(df, "v", ["g"]).collect()}
    plain = {r.g: (r.med, r.n, r.mad) for r in K.robust_baseline(df, "v", ["g"], 0.0).collect()}
    plain["none"] = (None, 0, None)  # the floor stands in for a missing spread there
    assert wide.keys() == plain.keys()
    for g, want in plain.items():
        assert all(a == b or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(wide[g], want, strict=True)), g
    one = K.nmad(df, "v").collect()
    assert len(one) == 1 and one[0].n == df.filter("v IS NOT NULL").count()


def test_nearest_outwards_equals_the_widest_radius(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)], "p long, x double, y double")
    nodes = spark.createDataFrame([(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(30)] + [(30, 1.0, 1.0), (31, 1.0, 1.0)], "n long, x double, y double")
    far = J.nearest(points, nodes, 1, 60.0, "p", "n").select("p", "n", "distance")
    out = J.nearest_outwards(points, nodes, [5.0, 20.0, 60.0], "p", "n").select("p", "n", "distance")
    assert sorted(out.collect()) == sorted(far.collect())
