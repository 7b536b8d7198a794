"""Summaries of Monte-Carlo draws: the nominal draw never enters a quantile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, value: str, keys, nominal=0, draw: str = "draw") -> DataFrame:
    other = F.when(F.col(draw) != nominal, F.col(value))
    q = F.percentile(other, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    a = df.groupBy(*keys).agg(F.sum(F.when(F.col(draw) == nominal, F.col(value))).alias("central"), q.alias("q"), F.count(other).alias("n_draws"))
    return a.select(*keys, "central", *(F.col("q")[i].alias(k) for i, k in enumerate(("p05", "p50", "p95"))), "n_draws")


def peak_dates(df: DataFrame, value: str, region: str, draw: str = "draw", date: str = "date") -> DataFrame:
    """On how many draws a date holds the maximum, the first of equal ones."""
    top = df.groupBy(region, draw).agg(F.max_by(date, F.struct(F.col(value), -F.col(date))).alias("date_of_maximum"))
    k = top.groupBy(region, "date_of_maximum").agg(F.count("*").alias("n"))
    return k.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(region)))


def convergence(df: DataFrame, value: str, sizes: list[int], draw: str = "draw", date: str = "date") -> DataFrame:
    """Quantiles over the first n draws, for each n."""
    each = df.withColumn("n_draws", F.explode(F.array(*(F.lit(n) for n in sizes)))).filter(F.col(draw) <= F.col("n_draws"))
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return each.groupBy("n_draws", date).agg(q.alias("q")).select("n_draws", date, *(F.col("q")[i].alias(k) for i, k in enumerate(("p05", "p50", "p95"))))
