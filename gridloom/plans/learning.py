"""Queries of the evidence model."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import learning as L
from gridloom.plans.cells import rounded
from gridloom.plans.registry import query


def labelled(df):
    return df.select("r", "c", "dem", "hand", "score", F.col("n").cast("double").alias("n"), (F.col("dem") + F.col("ground") < 27).cast("int").alias("y"), (F.floor(F.col("r") / 10) % 2).cast("int").alias("outer"), (F.floor(F.col("r") / 5) % 2).cast("int").alias("inner"))


@query("forest_out_of_fold", None, on="cells")
def forest_out_of_fold(df):
    x = L.out_of_fold(labelled(df).withColumnRenamed("score", "s"), ["dem", "hand", "s", "n"], "y", "outer", 2, trees=10, depth=4)
    return x.select("r", "c", "y", F.round("score", 6).alias("score"))


@query("nested_spatial_cv", None, on="cells")
def nested_spatial_cv(df):
    x = L.nested(labelled(df).withColumnRenamed("score", "s"), ["dem", "hand"], "y", "outer", "inner", 2, [(5, 3), (10, 4)])
    return x.groupBy("outer").agg(F.count("*").alias("n"), F.max("trees").alias("trees"), F.max("depth").alias("depth"), F.round(F.max("threshold"), 6).alias("threshold"))


@query("quantised_scores", "SELECT id, least(round_even(s * 10000, 0), 9999)::INT AS q, least(round_even(s * 10000, 0), 9999) >= 5000 AS state FROM scored", on="scored")
def quantised_scores(df):
    return L.quantised(df, "s", 5000).select("id", "q", "state")


_T = "t AS (SELECT tr, tc, i, j, dem AS s FROM cells, (SELECT unnest(range(0, 33, 4)) AS tr), (SELECT unnest(range(0, 33, 4)) AS tc), (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) WHERE r = tr + i AND c = tc + j)"


@query("blended_tiles", f"WITH {_T}, w AS (SELECT *, pow(sin(pi() * (i + 0.5) / 8), 2) * pow(sin(pi() * (j + 0.5) / 8), 2) AS w FROM t) SELECT tr + i AS r, tc + j AS c, round(sum(s * w) / sum(w), 6) AS score FROM w GROUP BY 1, 2", on="cells")
def blended_tiles(df):
    """Tiles over the full lattice of 40 x 40 cells."""
    return blend(df, F.sequence(F.lit(0), F.lit(32), F.lit(4)))


def blend(df, starts):
    x = df.withColumn("tr", F.explode(starts)).withColumn("tc", F.explode(starts)).withColumns({"i": F.col("r") - F.col("tr"), "j": F.col("c") - F.col("tc")})
    x = x.filter("i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7").select("tr", "tc", "i", "j", F.col("dem").alias("score"))
    return rounded(L.blended(x, 8), "score")


@query("pure_patches", "WITH p AS (SELECT pr, pc, count(*) AS n, min(r // 20) AS a, max(r // 20) AS b FROM cells, (SELECT unnest(range(0, 40, 4)) AS pr), (SELECT unnest(range(0, 40, 4)) AS pc) WHERE r BETWEEN pr AND pr + 7 AND c BETWEEN pc AND pc + 7 GROUP BY pr, pc) SELECT pr, pc, a AS role FROM p WHERE n = 64 AND a = b", on="cells")
def pure_patches(df):
    return L.patches(df.withColumn("role", F.expr("r div 20")), 8, 4)
