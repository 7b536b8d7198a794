"""Queries of node time series and surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import timeseries as S
from gridloom.plans.cells import rounded
from gridloom.plans.registry import fixture, query

_FIRST, _LAST = "2024-01-01", "2024-01-30"
_SPINE = "s AS (SELECT n.node, d.day, k.h FROM (SELECT DISTINCT node FROM node_day) n CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN node_day k ON k.node = n.node AND k.day = d.day)"
_FILL = _SPINE + """, o AS (SELECT *, CASE WHEN h IS NOT NULL THEN day END AS od FROM s),
 p AS (SELECT *, max(od) OVER (PARTITION BY node ORDER BY day) AS pd, min(od) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qd FROM o),
 q AS (SELECT p.*, a.h AS pv, b.h AS qv FROM p LEFT JOIN node_day a ON a.node = p.node AND a.day = p.pd LEFT JOIN node_day b ON b.node = p.node AND b.day = p.qd),
 f AS (SELECT node, day, h, CASE WHEN h IS NOT NULL THEN 0 WHEN pd IS NOT NULL AND qd IS NOT NULL THEN 1 ELSE 2 END AS kind, least(coalesce(day - pd, 999), coalesce(qd - day, 999))::INT AS gap,
  coalesce(h, pv + (qv - pv) * (day - pd) / nullif(qd - pd, 0), pv, qv) AS filled FROM q)"""


def spine(df):
    d = lambda x: F.lit(x).cast("date")
    return S.spine(df, "node", "day", d(_FIRST), d(_LAST))


@query("daily_median", "SELECT node, day, round(h, 6) AS h FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM node_day) WHERE n >= 3", on="obs")
def daily_median(df):
    return rounded(S.daily_median(df, "node", "day", "h", 3).select("node", "day", "h"), "h")


@query("date_spine", f"WITH {_SPINE} SELECT node, day, round(h, 6) AS h FROM s", on="node_day")
def date_spine(df):
    return rounded(spine(df).select("node", "day", "h"), "h")


@query("gap_fill", f"WITH {_FILL} SELECT node, day, kind, gap, round(filled, 6) AS filled FROM f", on="node_day")
def gap_fill(df):
    return rounded(S.fill(spine(df), "node", "day", "h").select("node", "day", "kind", "gap", "filled"), "filled")


@query("gap_fill_limited", f"WITH {_FILL} SELECT node, day, CASE WHEN gap > 1 THEN 3 ELSE kind END AS kind, round(CASE WHEN gap <= 1 THEN filled END, 6) AS filled FROM f", on="node_day")
def gap_fill_limited(df):
    return rounded(S.fill(spine(df), "node", "day", "h", most_gap=1).select("node", "day", "kind", "filled"), "filled")


@query("forward_fill_limit", f"WITH {_SPINE} SELECT node, day, round(last_value(h IGNORE NULLS) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ff, round(last_value(h IGNORE NULLS) OVER (PARTITION BY node ORDER BY day DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS bf FROM s", on="node_day")
def forward_fill(df):
    x = spine(df).withColumns({"ff": S.fill_limited("h", "node", "day", 2), "bf": S.fill_limited("h", "node", "day", 1, True)})
    return rounded(x.select("node", "day", "ff", "bf"), "ff", "bf")


@query("lag_and_cumulative", "SELECT node, day, round(h - lag(h) OVER w, 6) AS diff, round(sum(h) OVER (PARTITION BY node ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS cum, round(h / sum(h) OVER (PARTITION BY node), 6) AS share FROM node_day WINDOW w AS (PARTITION BY node ORDER BY day)", on="node_day")
def lag_and_cumulative(df):
    w = Window.partitionBy("node").orderBy("day")
    x = df.select("node", "day", (F.col("h") - F.lag("h").over(w)).alias("diff"), F.round(F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cum"), (F.col("h") / F.sum("h").over(Window.partitionBy("node"))).alias("share"))
    return rounded(x, "diff", "share")


@query("gap_runs", f"WITH {_SPINE}, m AS (SELECT *, h IS NULL AS i, row_number() OVER (PARTITION BY node ORDER BY day) - row_number() OVER (PARTITION BY node, h IS NULL ORDER BY day) AS g FROM s) SELECT node, min(day) AS start, max(day) AS stop, count(*) AS n_days FROM m WHERE i GROUP BY node, g", on="node_day")
def gap_runs(df):
    return S.runs(spine(df), "node", "day", F.col("h").isNull())


@query("gap_bins", f"WITH {_FILL} SELECT kind, CASE WHEN gap <= 1 THEN '0-1' WHEN gap <= 3 THEN '2-3' ELSE '4+' END AS bin, count(*) AS n FROM f GROUP BY ALL", on="node_day")
def gap_bins(df):
    f = S.fill(spine(df), "node", "day", "h")
    return f.groupBy("kind", F.when(F.col("gap") <= 1, "0-1").when(F.col("gap") <= 3, "2-3").otherwise("4+").alias("bin")).agg(F.count("*").alias("n"))


_CV = """WITH o AS (SELECT node, day, h FROM node_day), g AS (SELECT unnest([1, 2, 3, 4]) AS gap),
 r AS (SELECT o.node, o.day, o.h, g.gap, max(k.day) FILTER (k.day < o.day) AS pd, min(k.day) FILTER (k.day > o.day) AS qd FROM o CROSS JOIN g JOIN o k ON k.node = o.node AND abs(k.day - o.day) >= g.gap GROUP BY ALL),
 e AS (SELECT r.*, a.h AS pv, b.h AS qv FROM r LEFT JOIN o a ON a.node = r.node AND a.day = pd LEFT JOIN o b ON b.node = r.node AND b.day = qd WHERE least(coalesce(r.day - pd, 999), coalesce(qd - r.day, 999)) = gap),
 d AS (SELECT CASE WHEN pd IS NOT NULL AND qd IS NOT NULL THEN 'interpolated' ELSE 'held' END AS kind, gap, coalesce(pv + (qv - pv) * (day - pd) / (qd - pd), pv, qv) - h AS res FROM e),
 m AS (SELECT kind, gap, median(res) AS med FROM d GROUP BY ALL)
SELECT d.kind, d.gap, count(*) AS n, round(1.4826 * median(abs(res - med)), 6) AS nmad, round(sqrt(avg(res * res)), 6) AS rmse FROM d JOIN m USING (kind, gap) GROUP BY ALL"""


@query("gap_matched_cv", _CV, on="node_day")
def gap_matched_cv(df):
    """Every observation re-estimated from those at least g days away, booked where the nearest one is exactly g days away."""
    from gridloom.operators.composites import wide_baseline

    o = df.select("node", "day", "h").withColumn("gap", F.explode(F.array(*(F.lit(g) for g in (1, 2, 3, 4)))))
    k = df.select("node", F.struct(F.col("day").alias("d"), F.col("h").alias("v")).alias("k"))
    x = o.join(k, "node").filter(F.abs(F.datediff("k.d", "day")) >= F.col("gap"))
    r = x.groupBy("node", "day", "h", "gap").agg(F.max(F.when(F.col("k.d") < F.col("day"), F.col("k"))).alias("p"), F.min(F.when(F.col("k.d") > F.col("day"), F.col("k"))).alias("q"))
    a, b = F.datediff("day", "p.d"), F.datediff("q.d", "day")
    r = r.filter(F.least(a, b) == F.col("gap"))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * a / (a + b)
    r = r.select(F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), "interpolated").otherwise("held").alias("kind"), "gap", (F.coalesce(line, F.col("p.v"), F.col("q.v")) - F.col("h")).alias("res"))
    mad = wide_baseline(r, "res", ["kind", "gap"]).select("kind", "gap", "n", F.round(F.col("mad") * 1.4826, 6).alias("nmad"))
    return mad.join(r.groupBy("kind", "gap").agg(F.round(F.sqrt(F.avg(F.col("res") ** 2)), 6).alias("rmse")), ["kind", "gap"])


@query("bounded_interpolation", "WITH t AS (SELECT day_no * 7.0::DOUBLE AS xp, avg(value) AS fp FROM (SELECT floor(value / 10) AS day_no, value FROM events WHERE value < 60) GROUP BY day_no), s AS (SELECT xp AS a, fp AS fa, lead(xp) OVER (ORDER BY xp) AS b, lead(fp) OVER (ORDER BY xp) AS fb FROM t), p AS (SELECT node, x / 100 AS x FROM nodes) SELECT node, x, round(min(fa + (fb - fa) * (x - a) / (b - a)), 6) AS fp FROM p LEFT JOIN s ON b IS NOT NULL AND x BETWEEN a AND b GROUP BY node, x")
def bounded_interpolation(spark, sf):
    from gridloom.plans.registry import table

    t = table(spark, sf, "events").filter("value < 60").groupBy((F.floor(F.col("value") / 10) * 7.0).cast("double").alias("xp")).agg(F.avg("value").alias("fp"))
    p = fixture(spark, sf, "nodes").select("node", (F.col("x") / 100).alias("x"))
    return rounded(S.bounded_interpolation(p, t, "x", "xp", "fp", 7.0), "fp")


@query("nearest_states", "WITH s AS (SELECT *, CASE WHEN q > 40 THEN 1 WHEN q < 10 THEN 2 END AS st FROM cell_day) SELECT r, c, day, last_value(st IGNORE NULLS) OVER (PARTITION BY r, c ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(st IGNORE NULLS) OVER (PARTITION BY r, c ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM s", on="cell_day")
def nearest_states(df):
    st = F.when(F.col("q") > 40, 1).when(F.col("q") < 10, 2)
    return df.withColumns(S.nearest_states(df, ["r", "c"], "day", st)).select("r", "c", "day", "before", "after")


@query("retained_water", "WITH RECURSIVE x AS (SELECT r, c, day, q > 42 AS pot, t < 0.07 AND q < 49 AS keep, row_number() OVER (PARTITION BY r, c ORDER BY day) AS k FROM cell_day), w AS (SELECT r, c, day, k, pot AS wet FROM x WHERE k = 1 UNION ALL SELECT x.r, x.c, x.day, x.k, x.pot OR (w.wet AND x.keep) FROM w JOIN x ON x.r = w.r AND x.c = w.c AND x.k = w.k + 1) SELECT r, c, day, wet FROM w", on="cell_day")
def retained_water(df):
    return S.retained(df, ["r", "c"], "day", F.col("q") > 42, F.col("t") < 0.07, F.col("q") < 49).select("r", "c", "day", "wet")


@query("weekly_summary", f"WITH {_SPINE} SELECT node, date_trunc('week', day)::DATE AS week, count(h) AS n, round(CASE WHEN count(h) = count(*) THEN sum(h) END, 6) AS total, round(arg_max(h, day) FILTER (h IS NOT NULL), 6) AS last FROM s GROUP BY ALL", on="node_day")
def weekly_summary(df):
    h = F.col("h")
    x = spine(df).groupBy("node", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.count(h).alias("n"), F.when(F.count(h) == F.count("*"), F.sum(h)).alias("total"), F.max_by(h, F.when(h.isNotNull(), F.col("day"))).alias("last"))
    return rounded(x, "total", "last")


@query("distance_profile", "SELECT day, floor(sqrt(x * x + y * y) / 1000)::BIGINT AS km, round(median(h), 6) AS h FROM node_day JOIN nodes USING (node) WHERE river <> 'error' GROUP BY ALL")
def distance_profile(spark, sf):
    n = fixture(spark, sf, "nodes").filter("river <> 'error'").select("node", F.floor(F.hypot("x", "y") / 1000).alias("km"))
    return rounded(fixture(spark, sf, "node_day").join(n, "node").groupBy("day", "km").agg(F.median("h").alias("h")), "h")


@query("water_surface", "WITH p AS (SELECT r, c, c * 100.0 AS x, r * 100.0 AS y FROM cells), n AS (SELECT nodes.node, x, y, h FROM nodes LEFT JOIN node_day d ON d.node = nodes.node AND d.day = DATE '2024-01-10'), d AS (SELECT p.r, p.c, n.node, n.h, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) AS dist FROM p, n), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY dist, node) AS rk FROM d WHERE dist <= 5000), a AS (SELECT r, c, median(h) FILTER (rk <= 5 AND dist <= 600) AS near, arg_min(h, rk) FILTER (h IS NOT NULL) AS chain FROM k GROUP BY r, c) SELECT r, c, CASE WHEN near IS NOT NULL THEN 0 WHEN chain IS NOT NULL THEN 1 ELSE 3 END AS support, round(coalesce(near, chain), 6) AS h FROM a")
def water_surface(spark, sf):
    """Median of the five nearest nodes within a radius; where none of them has a height, the nearest one that has."""
    from gridloom.operators.joins import nearest, nearest_outwards

    p = fixture(spark, sf, "cells").select("r", "c", (F.col("c") * 100.0).alias("x"), (F.col("r") * 100.0).alias("y"))
    h = fixture(spark, sf, "node_day").filter("day = '2024-01-10'").select("node", "h")
    n = fixture(spark, sf, "nodes").select("node", "x", "y")
    near = nearest(p, n, 5, 600.0, ["r", "c"], "node").join(h, "node").groupBy("r", "c").agg(F.median("h").alias("near"))
    chain = nearest_outwards(p, n.join(h.filter("h IS NOT NULL").select("node"), "node"), [600.0, 1200.0, 2400.0, 5000.0], ["r", "c"], "node").join(h, "node")
    some = nearest_outwards(p, n, [600.0, 1200.0, 2400.0, 5000.0], ["r", "c"], "node").select("r", "c")
    a = some.join(near, ["r", "c"], "left").join(chain.select("r", "c", F.col("h").alias("chain")), ["r", "c"], "left")
    return a.select("r", "c", F.when(F.col("near").isNotNull(), 0).when(F.col("chain").isNotNull(), 1).otherwise(3).alias("support"), F.round(F.coalesce("near", "chain"), 6).alias("h"))


@query("event_relative_error", "WITH b AS (SELECT node, median(h) AS base FROM node_day WHERE day < DATE '2024-01-10' GROUP BY node) SELECT node, day, round(h - base, 6) AS dh FROM node_day JOIN b USING (node) WHERE day >= DATE '2024-01-10'", on="node_day")
def event_relative_error(df):
    base = df.filter("day < '2024-01-10'").groupBy("node").agg(F.median("h").alias("base"))
    return rounded(df.filter("day >= '2024-01-10'").join(base, "node").select("node", "day", (F.col("h") - F.col("base")).alias("dh")), "dh")


@query("seam_scan", "WITH m AS (SELECT c, avg(dem) AS m FROM cells GROUP BY c), w AS (SELECT c, sum(m) OVER (ORDER BY c ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS s FROM m), l AS (SELECT c, s, abs(s - lag(s) OVER (ORDER BY c)) AS d FROM w) SELECT round(max(d), 6) AS step, round(max(d) / stddev_pop(s), 6) AS ratio FROM l WHERE c BETWEEN 4 AND 35", on="cells")
def seam_scan(df):
    """Largest step of the smoothed column profile against its spread; the windows see one row per column."""
    w = Window.orderBy("c")
    m = df.groupBy("c").agg(F.avg("dem").alias("m")).withColumn("s", F.sum("m").over(w.rowsBetween(-4, 3)) / 8)
    m = m.withColumn("d", F.abs(F.col("s") - F.lag("s").over(w))).filter("c BETWEEN 4 AND 35")
    return rounded(m.agg(F.max("d").alias("step"), (F.max("d") / F.stddev_pop("s")).alias("ratio")), "step", "ratio")
