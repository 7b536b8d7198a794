"""Queries of joins, aggregations, dedup, ownership, set operations, sorts and grid geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import dedup as U
from gridloom.operators import joins as J
from gridloom.plans.cells import rounded
from gridloom.plans.registry import fixture, query, table

# --- joins -------------------------------------------------------------------------------------------------------------


@query("join_cell_aligned", "WITH m AS (SELECT r, c, median(b08) AS nir FROM stack GROUP BY r, c) SELECT r, c, round(nir, 9) AS nir, dem, ground FROM m JOIN cells USING (r, c)")
def join_cell_aligned(spark, sf):
    m = fixture(spark, sf, "stack").groupBy("r", "c").agg(F.round(F.median("b08"), 9).alias("nir"))
    return m.join(fixture(spark, sf, "cells").select("r", "c", "dem", "ground"), ["r", "c"])


@query("join_runs_suffixes", "SELECT a.region, a.date, a.draw AS draw_a, b.draw AS draw_b, round(a.area - b.area, 6) AS gap FROM draws a JOIN draws b ON a.region = b.region AND a.date = b.date AND a.draw % 7 = b.draw % 7 AND a.draw < b.draw")
def join_runs_suffixes(spark, sf):
    d = fixture(spark, sf, "draws").withColumn("k", F.col("draw") % 7).select("region", "date", "k", "draw", "area")
    a, b = (d.withColumnsRenamed({"draw": f"draw_{x}", "area": f"area_{x}"}) for x in "ab")
    return a.join(b, ["region", "date", "k"]).filter("draw_a < draw_b").select("region", "date", "draw_a", "draw_b", F.round(F.col("area_a") - F.col("area_b"), 6).alias("gap"))


@query("join_left_catalogue", "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def join_left_catalogue(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"))


@query("join_full_lineage", "WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F') SELECT coalesce(a.day, b.day) AS day, CASE WHEN a.day IS NOT NULL THEN 'safe' ELSE 'legacy' END AS lineage FROM a FULL JOIN b ON a.day = b.day")
def join_full_lineage(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("day")).distinct().withColumn("a", F.lit(True))
    b = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("day")).distinct()
    return a.join(b, "day", "full").select("day", F.when(F.col("a"), "safe").otherwise("legacy").alias("lineage"))


@query("join_pooled_lookup", "WITH g AS (SELECT ground, wc, avg(dem) AS b, count(*) AS n FROM cells GROUP BY ALL), p AS (SELECT ground, avg(dem) AS b FROM cells GROUP BY ground) SELECT r, c, round(dem - coalesce(CASE WHEN g.n >= 30 THEN g.b END, p.b, 0), 6) AS corrected FROM cells LEFT JOIN g USING (ground, wc) LEFT JOIN p USING (ground)", on="cells")
def join_pooled_lookup(df):
    """A class's own bias where it has enough rows, else that of its pool."""
    own = df.groupBy("ground", "wc").agg(F.avg("dem").alias("own"), F.count("*").alias("n_own"))
    pool = df.groupBy("ground").agg(F.avg("dem").alias("pool"))
    x = df.join(J.small(own), ["ground", "wc"], "left").join(J.small(pool), "ground", "left")
    bias = F.coalesce(F.when(F.col("n_own") >= 30, F.col("own")), F.col("pool"), F.lit(0.0))
    return x.select("r", "c", F.round(F.col("dem") - bias, 6).alias("corrected"))


@query("join_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_semi_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how: c.join(o, "c_custkey", f"left_{how}").agg(F.lit(how).alias("kind"), F.count("*").alias("n"))
    return count("semi").union(count("anti"))


@query("join_scene_pairs", "WITH s AS (SELECT DISTINCT orbit, r % 4 AS dir, win, day FROM sar) SELECT a.orbit, a.dir, count(*) AS n_pairs, min(a.day - b.day)::INT AS min_gap FROM s a JOIN s b ON a.orbit = b.orbit AND a.dir = b.dir AND a.win = 'event' AND b.win = 'pre' GROUP BY a.orbit, a.dir", on="sar")
def join_scene_pairs(df):
    """Pairs of scenes of all cells and months: each side is counted before the join, so no pair is made."""
    s = df.select("orbit", (F.col("r") % 4).alias("dir"), "win", "day").distinct()
    side = lambda w: s.filter(F.col("win") == w).groupBy("orbit", "dir").agg(F.count("*").alias(f"n_{w}"), F.min("day").alias(f"first_{w}"), F.max("day").alias(f"last_{w}"))
    x = side("event").join(side("pre"), ["orbit", "dir"])
    return x.select("orbit", "dir", (F.col("n_event") * F.col("n_pre")).alias("n_pairs"), F.datediff("first_event", "last_pre").alias("min_gap"))


@query("as_of_next_scene", "WITH d AS (SELECT node, day, h FROM node_day), s AS (SELECT DISTINCT node, day AS sday FROM obs WHERE river = 'purchase') SELECT d.node, d.day, s.sday AS scene, (s.sday - d.day)::INT AS lag FROM d ASOF LEFT JOIN s ON d.node = s.node AND d.day <= s.sday")
def as_of_next_scene(spark, sf):
    d = fixture(spark, sf, "node_day").select("node", "day")
    s = fixture(spark, sf, "obs").filter("river = 'purchase'").select("node", "day").distinct().withColumn("flag", F.lit(1))
    x = J.as_of(d, s, "day", "flag", by=["node"], direction="forward", out_on="scene")
    return x.select("node", "day", "scene", F.datediff("scene", "day").alias("lag"))


@query("as_of_latest_version", "WITH s AS (SELECT node, day AS sday, max(h) AS v FROM obs WHERE river = 'signup' GROUP BY ALL) SELECT d.node, d.day, s.sday AS version_day, round(s.v, 6) AS version FROM node_day d ASOF LEFT JOIN s ON d.node = s.node AND d.day >= s.sday")
def as_of_latest_version(spark, sf):
    s = fixture(spark, sf, "obs").filter("river = 'signup'").select("node", "day", "h")
    x = J.as_of(fixture(spark, sf, "node_day").select("node", "day"), s, "day", "h", by=["node"], out="version", out_on="version_day")
    return rounded(x.select("node", "day", "version_day", "version"), "version")


@query("same_season_partner", "WITH a AS (SELECT DISTINCT day, dayofyear(day) AS doy FROM cell_day WHERE year(day) = 1996), b AS (SELECT DISTINCT day, dayofyear(day) AS doy FROM cell_day WHERE year(day) = 1995) SELECT a.day, arg_min(b.day, (abs(a.doy - b.doy), b.day)) AS partner FROM a JOIN b ON abs(a.doy - b.doy) <= 12 GROUP BY a.day", on="cell_day")
def same_season_partner(df):
    """Partners for the days of all rows of the lattice."""
    return season_partners(df)


def season_partners(df):
    d = df.select("day").distinct().withColumn("doy", F.dayofyear("day"))
    a = d.filter("year(day) = 1996")
    b = d.filter("year(day) = 1995").select(F.col("day").alias("partner"), F.col("doy").alias("d0"), (F.col("doy") - 12).alias("lo"), (F.col("doy") + 12).alias("hi"))
    near = J.range_join(a, b, "doy", "lo", "hi", 25)
    return near.groupBy("day").agg(F.min_by("partner", F.struct(F.abs(F.col("doy") - F.col("d0")), "partner")).alias("partner"))


@query("nearest_nodes", "WITH p AS (SELECT r, c, c * 100.0 AS x, r * 100.0 AS y FROM cells), d AS (SELECT p.r, p.c, n.node, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) AS dist FROM p JOIN nodes n ON sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) <= 600), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY dist, node) AS rank FROM d) SELECT r, c, rank, node, round(dist, 6) AS distance FROM k WHERE rank <= 5")
def nearest_nodes(spark, sf):
    p = fixture(spark, sf, "cells").select("r", "c", (F.col("c") * 100.0).alias("x"), (F.col("r") * 100.0).alias("y"))
    k = J.nearest(p, fixture(spark, sf, "nodes"), 5, 600.0, ["r", "c"], "node")
    return rounded(k.select("r", "c", "rank", "node", "distance"), "distance")


_VGM = "WITH p AS (SELECT a.day, a.h - b.h AS dr, sqrt((na.x - nb.x) ** 2 + (na.y - nb.y) ** 2) AS d FROM node_day a JOIN node_day b ON a.day = b.day AND a.node < b.node JOIN nodes na ON na.node = a.node JOIN nodes nb ON nb.node = b.node), k AS (SELECT floor(d / 250)::BIGINT AS lag, dr FROM p WHERE d <= 1000) "


def variogram_pairs(spark, sf):
    d = fixture(spark, sf, "node_day").join(fixture(spark, sf, "nodes").select("node", "x", "y"), "node")
    p = J.radius_pairs(d.select("day", "node", "x", "y", "h"), "x", "y", 1000.0, "node", by=["day"])
    return p.select("day", (F.col("a.h") - F.col("b.h")).alias("dr"), "distance", F.floor(F.col("distance") / 250).alias("lag"))


@query("semivariogram", _VGM + "SELECT lag, count(*) AS n, round(avg(0.5 * dr * dr), 6) AS matheron, round(pow(avg(sqrt(abs(dr))), 4) / (2 * (0.457 + 0.494 / count(*))), 6) AS robust FROM k GROUP BY lag")
def semivariogram(spark, sf):
    n, root = F.count("*"), F.avg(F.sqrt(F.abs("dr")))
    v = variogram_pairs(spark, sf).groupBy("lag").agg(n.alias("n"), F.avg(0.5 * F.col("dr") ** 2).alias("matheron"), (F.pow(root, 4) / (2 * (0.457 + 0.494 / n))).alias("robust"))
    return rounded(v, "matheron", "robust")


@query("point_sample", "SELECT n.node, n.x, n.y, k.dem, coalesce(k.ground, 0) AS ground FROM nodes n LEFT JOIN cells k ON k.c = floor(n.x / 100) AND k.r = floor(n.y / 100)")
def point_sample(spark, sf):
    r, c = (x.cast("long") for x in U.physical_cells(F.col("y"), F.col("x"), 100.0))
    n = fixture(spark, sf, "nodes").withColumns({"r": r, "c": c})
    return n.join(fixture(spark, sf, "cells").select("r", "c", "dem", "ground"), ["r", "c"], "left").select("node", "x", "y", "dem", F.coalesce("ground", F.lit(0)).alias("ground"))


@query("bilinear_sample", "WITH p AS (SELECT node, x / 130 AS gx, y / 130 AS gy FROM nodes), k AS (SELECT p.*, floor(gy) + i AS rr, floor(gx) + j AS cc, CASE WHEN i = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END * CASE WHEN j = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END AS w FROM p, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j)) SELECT node, round(CASE WHEN count(dem) = count(*) THEN sum(w * dem) END, 6) AS dem FROM k LEFT JOIN cells ON r = rr AND c = cc WHERE w > 0 GROUP BY node")
def bilinear_sample(spark, sf):
    p = fixture(spark, sf, "nodes").select("node", (F.col("x") / 130).alias("gx"), (F.col("y") / 130).alias("gy"))
    return rounded(J.bilinear(p, fixture(spark, sf, "cells"), "gx", "gy", "dem", "node"), "dem")


_NINE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


@query("neighbour_purity", "SELECT a.r, a.c, count(b.r) AS n_neighbours, bool_and(b.ground = a.ground) AS pure, round(avg((b.dem < 24.5)::INT), 6) AS low_share FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c", on="cells")
def neighbour_purity(df):
    a = J.neighbours(df.select("r", "c", F.col("ground").alias("g")), _NINE)
    b = df.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "ground", "dem")
    return a.join(b, ["nr", "nc"]).groupBy("r", "c").agg(F.count("*").alias("n_neighbours"), F.bool_and(F.col("ground") == F.col("g")).alias("pure"), F.round(F.avg((F.col("dem") < 24.5).cast("int")), 6).alias("low_share"))


@query("self_base_difference", "SELECT a.draw, a.region, a.date, round(a.area - b.area, 6) AS increase FROM draws a LEFT JOIN draws b ON a.draw = b.draw AND a.region = b.region AND b.date = 1995", on="draws")
def self_base_difference(df):
    base = df.filter("date = 1995").select("draw", "region", F.col("area").alias("base"))
    return df.join(base, ["draw", "region"], "left").select("draw", "region", "date", F.round(F.col("area") - F.col("base"), 6).alias("increase"))


@query("frame_overlap", "WITH g AS (SELECT n_nationkey AS id, n_nationkey * 10.0 % 70 AS x0, n_nationkey * 10.0 % 70 + 25 AS x1, n_regionkey * 10.0 AS y0, n_regionkey * 10.0 + 15 AS y1 FROM nation) SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0))::DOUBLE AS width, (least(a.y1, b.y1) - greatest(a.y0, b.y0))::DOUBLE AS height FROM g a JOIN g b ON a.id < b.id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)")
def frame_overlap(spark, sf):
    k = F.col("n_nationkey") * 10.0 % 70
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), k.alias("x0"), (k + 25).alias("x1"), (F.col("n_regionkey") * 10.0).alias("y0"), (F.col("n_regionkey") * 10.0 + 15).alias("y1"))
    a, b = (g.select(*(F.col(c).alias(f"{p}_{c}") for c in g.columns)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{p}_x0") / 25), F.floor(F.col(f"{p}_x1") / 25)))) for p in "ab")
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    return a.join(b, "cell").filter("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), w.alias("width"), h.cast("double").alias("height")).withColumn("width", F.col("width").cast("double")).filter("width > 0 AND height > 0").distinct()


@query("nearest_centroid", "WITH z AS (SELECT wc, avg(c) * 100.0 AS x, avg(r) * 100.0 AS y FROM cells WHERE n > 40 GROUP BY wc), d AS (SELECT n.node, z.wc, sqrt((n.x - z.x) ** 2 + (n.y - z.y) ** 2) AS dist, row_number() OVER (PARTITION BY n.node ORDER BY round(sqrt((n.x - z.x) ** 2 + (n.y - z.y) ** 2), 9), z.wc) AS k FROM nodes n, z) SELECT node, wc, round(dist, 6) AS distance FROM d WHERE k = 1 AND dist <= 1500")
def nearest_centroid(spark, sf):
    z = fixture(spark, sf, "cells").filter("n > 40").groupBy("wc").agg((F.avg("c") * 100.0).alias("zx"), (F.avg("r") * 100.0).alias("zy"))
    x = J.nearest(fixture(spark, sf, "nodes").select("node", "x", "y"), z.select("wc", F.col("zx").alias("x"), F.col("zy").alias("y")), 1, 1500.0, "node", "wc")
    return rounded(x.select("node", "wc", "distance"), "distance")


# --- aggregations ------------------------------------------------------------------------------------------------------


@query("coded_accounting", "SELECT c % 4 AS zone, count(*) FILTER (code & 1 > 0) AS corridor, count(*) FILTER (code & 2 > 0) AS valley, count(*) FILTER (code & 4 > 0) AS floodplain, round(sum(CASE WHEN code & 1 > 0 THEN dem ELSE 0 END), 6) AS volume FROM (SELECT *, (r < 30)::INT + 2 * (c < 20)::INT + 4 * (dem < 25)::INT AS code FROM cells) GROUP BY c % 4", on="cells")
def coded_accounting(df):
    code = (F.col("r") < 30).cast("int") + 2 * (F.col("c") < 20).cast("int") + 4 * (F.col("dem") < 25).cast("int")
    x = df.withColumn("code", code)
    bit = lambda b: F.col("code").bitwiseAND(F.lit(b)) > 0
    return x.groupBy((F.col("c") % 4).alias("zone")).agg(F.count_if(bit(1)).alias("corridor"), F.count_if(bit(2)).alias("valley"), F.count_if(bit(4)).alias("floodplain"), F.round(F.sum(F.when(bit(1), F.col("dem")).otherwise(0.0)), 6).alias("volume"))


@query("overlapping_regions", "SELECT region, count(*) AS n, round(sum(dem) * 400 / 1e6, 9) AS hm3 FROM (SELECT dem, unnest(list_filter([CASE WHEN r < 30 THEN 'corridor' END, CASE WHEN c < 20 THEN 'valley' END, 'total'], lambda x: x IS NOT NULL)) AS region FROM cells) GROUP BY region", on="cells")
def overlapping_regions(df):
    names = F.array_compact(F.array(F.when(F.col("r") < 30, "corridor"), F.when(F.col("c") < 20, "valley"), F.lit("total")))
    return df.withColumn("region", F.explode(names)).groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("dem") * 400 / 1e6, 9).alias("hm3"))


@query("crosstab", "SELECT ground, wc, count(*) AS n, round(count(*) * 1e-4, 6) AS km2 FROM cells GROUP BY ALL", on="cells")
def crosstab(df):
    return df.groupBy("ground", "wc").agg(F.count("*").alias("n"), F.round(F.count("*") * 1e-4, 6).alias("km2"))


@query("transition_matrix", "WITH t AS (SELECT r, c, max(scl) FILTER (win = 'pre') AS a, max(scl) FILTER (win = 'event') AS b FROM stack GROUP BY r, c), k AS (SELECT a, b, count(*) AS n FROM t GROUP BY ALL) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share_of_from FROM k", on="stack")
def transition_matrix(df):
    t = df.groupBy("r", "c").agg(F.max(F.when(F.col("win") == "pre", F.col("scl"))).alias("a"), F.max(F.when(F.col("win") == "event", F.col("scl"))).alias("b"))
    return t.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("share_of_from", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


@query("five_way_size", "SELECT win, scl, orbit, dir, half, count(*) AS n FROM (SELECT win, scl, line % 3 AS orbit, r % 2 AS dir, c < 20 AS half FROM stack) GROUP BY ALL", on="stack")
def five_way_size(df):
    return df.groupBy("win", "scl", (F.col("line") % 3).alias("orbit"), (F.col("r") % 2).alias("dir"), (F.col("c") < 20).alias("half")).agg(F.count("*").alias("n"))


@query("pivot_windows", "SELECT r, count(*) FILTER (win = 'pre') AS pre, count(*) FILTER (win = 'event') AS event, count(*) FILTER (win = 'trace') AS trace FROM stack GROUP BY r", on="stack")
def pivot_windows(df):
    return df.groupBy("r").pivot("win", ["pre", "event", "trace"]).count().fillna(0)


@query("melt_bands", "SELECT scene, line, band, value FROM (SELECT scene, line, b02, b03, b04 FROM stack) UNPIVOT (value FOR band IN (b02, b03, b04))", on="stack")
def melt_bands(df):
    return df.select("scene", "line", "b02", "b03", "b04").unpivot(["scene", "line"], ["b02", "b03", "b04"], "band", "value")


@query("joined_sets", "SELECT r, string_agg(DISTINCT win, '|' ORDER BY win) AS wins, count(DISTINCT scl) AS n_scl FROM stack GROUP BY r", on="stack")
def joined_sets(df):
    return df.groupBy("r").agg(F.concat_ws("|", F.array_sort(F.collect_set("win"))).alias("wins"), F.count_distinct("scl").alias("n_scl"))


@query("rollup_totals", "SELECT coalesce(win, 'ALL') AS win, coalesce(ground::VARCHAR, 'ALL') AS ground, n, g FROM (SELECT win, line AS ground, count(*) AS n, grouping(win, line) AS g FROM stack GROUP BY ROLLUP (win, line))", on="stack")
def rollup_totals(df):
    g = df.rollup("win", "line").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.coalesce("win", F.lit("ALL")).alias("win"), F.coalesce(F.col("line").cast("string"), F.lit("ALL")).alias("ground"), "n", "g")


@query("cube_totals", "SELECT win, scl, count(*) AS n, grouping(win, scl) AS g FROM stack GROUP BY CUBE (win, scl)", on="stack")
def cube_totals(df):
    return df.cube("win", "scl").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select("win", "scl", "n", "g")


@query("any_all_dates", "SELECT r, c, bool_or(q > 45) AS any_high, bool_and(q > 5) AS all_low FROM cell_day GROUP BY r, c", on="cell_day")
def any_all_dates(df):
    return df.groupBy("r", "c").agg(F.bool_or(F.col("q") > 45).alias("any_high"), F.bool_and(F.col("q") > 5).alias("all_low"))


@query("wet_day_marks", "WITH w AS (SELECT *, q > 40 AS wet FROM cell_day), l AS (SELECT r, c, min(day) FILTER (wet) AS first_wet, max(day) FILTER (wet) AS last_wet, count(*) FILTER (wet) AS n_wet FROM w GROUP BY r, c) SELECT l.r, l.c, first_wet, last_wet, n_wet, min(day) FILTER (NOT wet AND day > last_wet) AS first_dry FROM l JOIN w USING (r, c) GROUP BY l.r, l.c, first_wet, last_wet, n_wet", on="cell_day")
def wet_day_marks(df):
    w = df.withColumn("wet", F.col("q") > 40)
    last = F.max(F.when(F.col("wet"), F.col("day"))).over(Window.partitionBy("r", "c"))
    x = w.withColumn("last", last)
    return x.groupBy("r", "c").agg(F.min(F.when(F.col("wet"), F.col("day"))).alias("first_wet"), F.max("last").alias("last_wet"), F.count_if("wet").alias("n_wet"), F.min(F.when(~F.col("wet") & (F.col("day") > F.col("last")), F.col("day"))).alias("first_dry"))


@query("exposure_day", "WITH w AS (SELECT *, q > 40 AS wet FROM cell_day) SELECT r, c, coalesce(datediff('day', DATE '1996-01-01', min(day) FILTER (NOT wet AND day >= DATE '1996-01-01'))::INT, 9999) AS exposed FROM w GROUP BY r, c", on="cell_day")
def exposure_day(df):
    day = F.min(F.when((F.col("q") <= 40) & (F.col("day") >= F.lit("1996-01-01").cast("date")), F.col("day")))
    return df.groupBy("r", "c").agg(F.coalesce(F.datediff(day, F.lit("1996-01-01").cast("date")), F.lit(9999)).alias("exposed"))


@query("hypsometry", "SELECT lv AS level, count(*) FILTER (dem < lv) AS n, round(sum(greatest(lv - dem, 0)), 6) AS volume FROM cells, (SELECT unnest([15.0, 20.0, 25.0, 30.0, 35.0]::DOUBLE[]) AS lv) GROUP BY lv", on="cells")
def hypsometry(df):
    x = df.withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in (15, 20, 25, 30, 35)))))
    return x.groupBy("level").agg(F.count_if(F.col("dem") < F.col("level")).alias("n"), F.round(F.sum(F.greatest(F.col("level") - F.col("dem"), F.lit(0.0))), 6).alias("volume"))


@query("data_quality_shares", "SELECT orbit, count(*) AS n, round(avg((vv > 0)::INT), 6) AS nonzero, round(avg((vv > 1)::INT), 6) AS above_one FROM sar GROUP BY orbit", on="sar")
def data_quality_shares(df):
    return df.groupBy("orbit").agg(F.count("*").alias("n"), F.round(F.avg((F.col("vv") > 0).cast("int")), 6).alias("nonzero"), F.round(F.avg((F.col("vv") > 1).cast("int")), 6).alias("above_one"))


@query("difference_in_differences", "WITH m AS (SELECT date, avg(area) FILTER (region = 1) AS t, avg(area) FILTER (region = 2) AS k FROM draws GROUP BY date) SELECT a.date, round(a.t - a.k, 6) AS gap, round((a.t - a.k) - (b.t - b.k), 6) AS did FROM m a, (SELECT * FROM m WHERE date = 1995) b WHERE a.date > 1995", on="draws")
def did(df):
    p = df.groupBy("date").pivot("region", [1, 2]).agg(F.avg("area")).select("date", (F.col("1") - F.col("2")).alias("gap"))
    base = p.filter("date = 1995").select(F.col("gap").alias("base"))  # one row
    return rounded(p.filter("date > 1995").crossJoin(F.broadcast(base)).select("date", "gap", (F.col("gap") - F.col("base")).alias("did")), "gap", "did")


@query("recession_slope", "WITH a AS (SELECT date - 1995 AS t, sum(area) AS a FROM draws GROUP BY date) SELECT count(*) AS n, round(regr_slope(ln(a), t), 9) AS slope, round(-1 / regr_slope(ln(a), t), 4) AS tau FROM a WHERE a > 0", on="draws")
def recession_slope(df):
    a = df.groupBy((F.col("date") - 1995).alias("t")).agg(F.sum("area").alias("a")).filter("a > 0")
    slope = F.regr_slope(F.log("a"), F.col("t").cast("double"))
    return a.agg(F.count("*").alias("n"), F.round(slope, 9).alias("slope"), F.round(-1 / slope, 4).alias("tau"))


@query("otsu_threshold", "WITH h AS (SELECT floor(dem)::INT AS b, count(*) AS n FROM cells GROUP BY ALL), k AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS w, sum(n * b) OVER () AS s FROM h), v AS (SELECT b, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS between_var FROM k WHERE w > w0) SELECT arg_max(b, (round(between_var, 3), -b)) AS threshold FROM v", on="cells")
def otsu(df):
    """Threshold of the largest between-class variance of a histogram: the windows see its bins."""
    h = df.groupBy(F.floor("dem").cast("int").alias("b")).agg(F.count("*").alias("n"))
    up, whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    k = h.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("b")).over(up), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("b")).over(whole)}).filter("w > w0")
    v = F.round(F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), F.lit(2)), 3)
    return k.agg(F.max_by("b", F.struct(v.alias("v"), (-F.col("b")).alias("m"))).alias("threshold"))


@query("strata_statistics", "SELECT ground, count(*) AS n, round(quantile_cont(dem, 0.1), 6) AS p10, round(quantile_cont(dem, 0.5), 6) AS p50, round(quantile_cont(dem, 0.9), 6) AS p90, round(avg(dem), 6) AS mean, round(stddev_pop(dem), 6) AS sd FROM cells GROUP BY ground HAVING count(*) >= 20", on="cells")
def strata_statistics(df):
    q = F.percentile("dem", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    x = df.groupBy("ground").agg(F.count("*").alias("n"), q.alias("q"), F.avg("dem").alias("mean"), F.stddev_pop("dem").alias("sd")).filter("n >= 20")
    return rounded(x.select("ground", "n", *(F.col("q")[i].alias(k) for i, k in enumerate(("p10", "p50", "p90"))), "mean", "sd"), "p10", "p50", "p90", "mean", "sd")


@query("depth_summary", "SELECT count(*) AS n, round(avg(30 - dem), 6) AS mean, round(median(30 - dem), 6) AS median, round(quantile_cont(30 - dem, 0.95), 6) AS p95, round(max(30 - dem), 6) AS deepest, round(avg((30 - dem > 5)::INT), 6) AS share_deep FROM cells WHERE dem < 30", on="cells")
def depth_summary(df):
    from gridloom.operators.indices import depth

    x = df.select(depth(F.lit(30.0), F.col("dem")).alias("d")).filter("d IS NOT NULL")
    return rounded(x.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.percentile("d", F.lit(0.95)).alias("p95"), F.max("d").alias("deepest"), F.avg((F.col("d") > 5).cast("int")).alias("share_deep")), "mean", "median", "p95", "deepest", "share_deep")


@query("banded_profile", "SELECT floor((r * 100.0 - 50) / 2000)::BIGINT AS band, count(*) AS n, round(median(dem), 6) AS dem FROM cells GROUP BY 1", on="cells")
def banded_profile(df):
    return rounded(df.groupBy(F.floor((F.col("r") * 100.0 - 50) / 2000).alias("band")).agg(F.count("*").alias("n"), F.median("dem").alias("dem")), "dem")


@query("k_of_n_detections", "WITH d AS (SELECT r, c, count(DISTINCT line % 3) FILTER (b04 > 0.8) AS k FROM stack GROUP BY r, c) SELECT r, c, k >= 2 AS two_of_three, k >= 1 AS any_of_three FROM d", on="stack")
def k_of_n(df):
    d = df.groupBy("r", "c").agg(F.count_distinct(F.when(F.col("b04") > 0.8, F.col("line") % 3)).alias("k"))
    return d.select("r", "c", (F.col("k") >= 2).alias("two_of_three"), (F.col("k") >= 1).alias("any_of_three"))


@query("linear_discriminant", "WITH s AS (SELECT dem < 24.5 AS w, avg(hand) AS a, avg(score) AS b, var_pop(hand) AS va, var_pop(score) AS vb, covar_pop(hand, score) AS ab, count(*) AS n FROM cells GROUP BY 1), p AS (SELECT x.a - y.a AS da, x.b - y.b AS db, (x.va * x.n + y.va * y.n) / (x.n + y.n) AS va, (x.vb * x.n + y.vb * y.n) / (x.n + y.n) AS vb, (x.ab * x.n + y.ab * y.n) / (x.n + y.n) AS ab FROM s x, s y WHERE x.w AND NOT y.w) SELECT round((vb * da - ab * db) / (va * vb - ab * ab), 6) AS w_hand, round((va * db - ab * da) / (va * vb - ab * ab), 6) AS w_score FROM p", on="cells")
def linear_discriminant(df):
    """Two-class, two-feature discriminant from one row of moments per class; as in the SQL, no row where a class has no cell."""
    m = df.groupBy((F.col("dem") < 24.5).alias("w")).agg(F.avg("hand").alias("a"), F.avg("score").alias("b"), F.var_pop("hand").alias("va"), F.var_pop("score").alias("vb"), F.covar_pop("hand", "score").alias("ab"), F.count("*").alias("n"))
    one = lambda w: m.filter(F.col("w") == w).agg(*(F.max(c).alias(f"{c}_{int(w)}") for c in ("a", "b", "va", "vb", "ab", "n")))
    p = one(True).crossJoin(one(False)).filter("n_1 IS NOT NULL AND n_0 IS NOT NULL")  # one row on either side
    pool = lambda k: (F.col(f"{k}_1") * F.col("n_1") + F.col(f"{k}_0") * F.col("n_0")) / (F.col("n_1") + F.col("n_0"))
    va, vb, ab, da, db = pool("va"), pool("vb"), pool("ab"), F.col("a_1") - F.col("a_0"), F.col("b_1") - F.col("b_0")
    det = va * vb - ab * ab
    return rounded(p.select(F.try_divide(vb * da - ab * db, det).alias("w_hand"), F.try_divide(va * db - ab * da, det).alias("w_score")), "w_hand", "w_score")


@query("scene_iou", "WITH s AS (SELECT DISTINCT line, r, c FROM stack WHERE b04 > 0.5), f AS (SELECT DISTINCT line, r, c FROM stack) SELECT a.line AS a, b.line AS b, count(*) FILTER (x.r IS NOT NULL AND y.r IS NOT NULL) AS inter, count(*) FILTER (x.r IS NOT NULL OR y.r IS NOT NULL) AS uni FROM f a JOIN f b ON a.r = b.r AND a.c = b.c AND a.line < b.line LEFT JOIN s x ON x.line = a.line AND x.r = a.r AND x.c = a.c LEFT JOIN s y ON y.line = b.line AND y.r = b.r AND y.c = b.c GROUP BY a.line, b.line", on="stack")
def scene_iou(df):
    s = df.groupBy("line", "r", "c").agg(F.bool_or(F.col("b04") > 0.5).alias("w"))
    a, b = (s.select("r", "c", F.col("line").alias(k), F.col("w").alias(f"w{k}")) for k in "ab")
    x = a.join(b, ["r", "c"]).filter("a < b")
    return x.groupBy("a", "b").agg(F.count_if(F.col("wa") & F.col("wb")).alias("inter"), F.count_if(F.col("wa") | F.col("wb")).alias("uni"))


# --- dedup, ownership, sets, order -------------------------------------------------------------------------------------


@query("best_baseline", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) = 1)")
def best_baseline(spark, sf):
    x = U.best_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderpriority").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return x.select("o_custkey", "o_orderkey", "o_totalprice")


@query("first_valid_mosaic", "WITH v AS (SELECT * FROM stack WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND b03 > 0) SELECT r, c, arg_min(b04, (day, scene, line, b04, b08)) AS b04, arg_min(b08, (day, scene, line, b04, b08)) AS b08, count(*) AS n_sources FROM v GROUP BY r, c", on="stack")
def first_valid_mosaic(df):
    from gridloom.operators.indices import is_valid

    return U.first_valid_mosaic(df, ["r", "c"], ["b04", "b08"], [F.col(k) for k in ("day", "scene", "line", "b04", "b08")], is_valid(F.col("scl"), F.col("b03")))


@query("mosaic_seams", "WITH p AS (SELECT r, c, year(day) AS scene, max(vv) AS vv, max(vh) AS vh FROM sar GROUP BY ALL), v AS (SELECT r, c, scene, 10 * log10(greatest(vv, 1e-6)) AS db FROM p WHERE vv > 0 AND vh > 0), f AS (SELECT *, first_value(db) OVER (PARTITION BY r, c ORDER BY scene) AS base, min(scene) OVER (PARTITION BY r, c) AS first FROM v), m AS (SELECT scene, count(*) AS n, CASE WHEN count(*) > 100 THEN median(abs(db - base)) END AS seam FROM f WHERE scene > first GROUP BY scene) SELECT scene, n AS n_overlap, round(seam, 6) AS seam FROM m UNION ALL SELECT NULL, (sum(n) FILTER (seam IS NOT NULL))::BIGINT, round(median(seam), 6) FROM m", on="sar")
def mosaic_seams(df):
    """Each year's strongest returns as a scene."""
    p = df.groupBy("r", "c", F.year("day").alias("scene")).agg(F.max("vv").alias("vv"), F.max("vh").alias("vh")).filter("vv > 0 AND vh > 0")
    db = p.select("r", "c", "scene", (10 * F.log10(F.greatest(F.col("vv").cast("double"), F.lit(1e-6)))).alias("db"))
    return rounded(U.mosaic_seams(db, ["r", "c"], "scene", "db", 100), "seam")


@query("state_on_day", "WITH v AS (SELECT node, day, round(h, 6) AS h FROM node_day) SELECT node, min(day) AS created, bool_or(day <= DATE '2024-01-10') AS existed, arg_max(h, day) FILTER (day <= DATE '2024-01-10') AS state, bool_or(day <= DATE '2024-01-10') AND arg_max(h, day) FILTER (day <= DATE '2024-01-10') IS NOT DISTINCT FROM arg_max(h, day) AS same FROM v GROUP BY node", on="node_day")
def state_on_day(df):
    return U.state_on(df.select("node", "day", F.round("h", 6).alias("h")), ["node"], "day", "h", F.lit("2024-01-10").cast("date"))


@query("last_paste", "WITH p AS (SELECT r, c, line, CASE WHEN max(b03) > 0.07 THEN NULL ELSE max(b03) END AS v FROM stack GROUP BY ALL) SELECT r, c, arg_max_null(v, line) AS pasted, arg_max(v, line) FILTER (v IS NOT NULL) AS labelled FROM p GROUP BY r, c", on="stack")
def last_paste(df):
    p = df.groupBy("r", "c", "line").agg(F.max("b03").alias("v")).withColumn("v", F.when(~(F.col("v") > 0.07), F.col("v")))
    a = U.last_paste(p, ["r", "c"], "v", "line").withColumnRenamed("v", "pasted")
    return a.join(U.last_paste(p, ["r", "c"], "v", "line", True).withColumnRenamed("v", "labelled"), ["r", "c"], "left")


@query("frame_ownership", "SELECT line AS member, count(*) AS n_cells, count(*) FILTER (owned) AS n_owned FROM (SELECT line, r, c, line = min(line) OVER (PARTITION BY r, c) AS owned FROM (SELECT DISTINCT line, r, c FROM stack)) GROUP BY line", on="stack")
def frame_ownership(df):
    x = U.owned_by_first(df.select("line", "r", "c").distinct(), ["r", "c"], "line")
    return x.groupBy(F.col("line").alias("member")).agg(F.count("*").alias("n_cells"), F.count_if("owned").alias("n_owned"))


@query("physical_uniqueness", "SELECT count(*) AS n_rows, count(DISTINCT (floor(x / 50), floor(y / 50))) AS n_floor FROM nodes", on="nodes")
def physical_uniqueness(df):
    a, b = U.physical_cells(F.col("x"), F.col("y"), 50.0)
    return U.duplicates(df.select(a.alias("a"), b.alias("b")), ["a", "b"]).select("n_rows", F.col("n_keys").alias("n_floor"))


_SETS = "WITH a AS (SELECT r, c FROM cells WHERE dem < 24.5), b AS (SELECT r, c FROM cells WHERE score > 0.4003) "


@query("set_operations", _SETS + "SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))", on="cells")
def set_operations(df):
    a, b = df.filter("dem < 24.5").select("r", "c"), df.filter("score > 0.4003").select("r", "c")
    count = lambda name, x: x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    sym = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["r", "c"], "full").filter("a IS NULL OR b IS NULL")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.join(b, ["r", "c"], "left_anti"))).union(count("symmetric", sym))


@query("concat_all", "SELECT 'stack' AS src, r, c, NULL::DOUBLE AS dem FROM stack UNION ALL SELECT 'cells', r, c, dem FROM cells")
def concat_all(spark, sf):
    a = fixture(spark, sf, "stack").select(F.lit("stack").alias("src"), "r", "c")
    return a.unionByName(fixture(spark, sf, "cells").select(F.lit("cells").alias("src"), "r", "c", "dem"), allowMissingColumns=True)


@query("top_cells_per_class", "SELECT ground, r, c, dem, k FROM (SELECT *, row_number() OVER (PARTITION BY ground ORDER BY dem DESC, r, c) AS k FROM cells) WHERE k <= 3", on="cells")
def top_cells(df):
    w = Window.partitionBy("ground").orderBy(F.col("dem").desc(), "r", "c")
    return df.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("ground", "r", "c", "dem", "k")


@query("top_scenes", "SELECT scene, count(*) AS n FROM stack GROUP BY scene ORDER BY n DESC, scene LIMIT 10", on="stack")
def top_scenes(df):
    return df.groupBy("scene").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "scene").limit(10)


@query("argmax_first_tie", "SELECT draw, arg_max(date, (area, -date)) AS day FROM (SELECT draw, date, sum(area) AS area FROM draws GROUP BY ALL) GROUP BY draw", on="draws")
def argmax_first_tie(df):
    d = df.groupBy("draw", "date").agg(F.sum("area").alias("area"))
    return d.groupBy("draw").agg(F.max_by("date", F.struct(F.col("area"), -F.col("date"))).alias("day"))


@query("upsert_ledger", "WITH o AS (SELECT r, c, dem, 0 AS v FROM cells WHERE r < 30), n AS (SELECT r, c, dem + 1 AS dem, 1 AS v FROM cells WHERE r >= 20) SELECT v, count(*) AS n, round(sum(dem), 6) AS s FROM (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.r = o.r AND n.c = o.c) UNION ALL SELECT * FROM n) GROUP BY v", on="cells")
def upsert_ledger(df):
    old = df.filter("r < 30").select("r", "c", "dem", F.lit(0).alias("v"))
    new = df.filter("r >= 20").select("r", "c", (F.col("dem") + 1).alias("dem"), F.lit(1).alias("v"))
    return J.upsert(old, new, ["r", "c"]).groupBy("v").agg(F.count("*").alias("n"), F.round(F.sum("dem"), 6).alias("s"))


# --- grid geometry -----------------------------------------------------------------------------------------------------


@query("snap_out", "SELECT river, floor(min(x) / 120) * 120 AS x0, ceil(max(x) / 120) * 120 AS x1, floor(min(y) / 120) * 120 AS y0, ceil(max(y) / 120) * 120 AS y1 FROM nodes GROUP BY river", on="nodes")
def snap_out(df):
    from gridloom.operators.grid import snap_out as snap

    return df.groupBy("river").agg(*(x.cast("double").alias(k) for k, x in snap("x", "y", 120.0).items()))


@query("strict_mean_2x2", "SELECT r // 2 AS pr, c // 2 AS pc, round(CASE WHEN count(v) = 4 THEN avg(v) END, 6) AS v FROM (SELECT r, c, CASE WHEN n > 20 THEN dem END AS v FROM cells) GROUP BY 1, 2", on="cells")
def strict_mean(df):
    from gridloom.operators.grid import aggregate_blocks

    return rounded(aggregate_blocks(df.withColumn("v", F.when(F.col("n") > 20, F.col("dem"))), "v", 2, strict=True), "v")


@query("valid_share_resample", "SELECT r // 4 AS pr, c // 4 AS pc, round(avg((n > 30)::INT), 6) AS valid_share, CASE WHEN avg((n > 30)::INT) >= 0.75 THEN avg(CASE WHEN n > 30 THEN (dem < 24.5)::INT END) >= 0.5 END AS water FROM cells GROUP BY 1, 2", on="cells")
def valid_share_resample(df):
    from gridloom.operators.grid import majority_of_valid

    return rounded(majority_of_valid(df, F.col("n") > 30, F.col("dem") < 24.5, 4), "valid_share")


@query("max_downsample", "SELECT r // 3 AS pr, c // 3 AS pc, bool_or(dem < 20) AS any_low FROM cells GROUP BY 1, 2", on="cells")
def max_downsample(df):
    return df.groupBy(F.expr("r div 3").alias("pr"), F.expr("c div 3").alias("pc")).agg(F.bool_or(F.col("dem") < 20).alias("any_low"))


@query("nearest_reproject", "WITH d AS (SELECT r AS dr, c AS dc, floor((r * 15.0 + 7.5 - 4) / 20)::BIGINT AS sr, floor((c * 15.0 + 7.5 + 6) / 20)::BIGINT AS sc FROM cells) SELECT dr AS r, dc AS c, dem FROM d LEFT JOIN cells ON r = sr AND c = sc", on="cells")
def nearest_reproject(df):
    from gridloom.operators.grid import nearest_onto

    return nearest_onto(df.select("r", "c"), df.select("r", "c", "dem"), dst=(15.0, 0.0, 0.0), src=(20.0, -6.0, 4.0))


@query("union_window", "SELECT min(c) AS c0, min(r) AS r0, max(c) - min(c) + 1 AS nx, max(r) - min(r) + 1 AS ny FROM (SELECT r, c FROM cells WHERE ground < 3 UNION ALL SELECT r + 5, c + 5 FROM cells WHERE ground >= 3)", on="cells")
def union_window(df):
    from gridloom.operators.grid import embed, union_grid

    return union_grid(df.filter("ground < 3").select("r", "c").union(embed(df.filter("ground >= 3"), 5, 5).select("r", "c")))


@query("block_ids", "SELECT CAST(floor(y / 350) * 1e6 + floor(x / 350) AS BIGINT) AS block, count(*) AS n FROM nodes GROUP BY 1", on="nodes")
def block_ids(df):
    from gridloom.operators.grid import block_id

    return df.groupBy(block_id(F.col("x"), F.col("y"), 350.0).alias("block")).agg(F.count("*").alias("n"))


@query("utm_coordinates", None, on="nodes")
def utm_coordinates(df):
    from gridloom.operators.grid import utm

    e, n = utm(30 + F.col("x") / 1000, 46 + F.col("y") / 1000, 33.0)
    return df.select("node", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("chainage", "WITH s AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 2500.0, 1500.0, 0.0), (1, 2500.0, 1500.0, 5000.0, 5000.0, sqrt(2500.0 ** 2 + 1500.0 ** 2))) AS t(k, x0, y0, x1, y1, base)), p AS (SELECT n.node, s.k, base, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t, x, y, x0, y0, x1, y1 FROM nodes n, s), d AS (SELECT node, k, base + t * len AS chain, round(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2), 9) AS dist FROM p) SELECT node, round(arg_min(chain, (dist, k)), 6) AS chain, round(min(dist), 6) AS dist FROM d GROUP BY node", on="nodes")
def chainage(df):
    from gridloom.operators.grid import chainage_on

    return rounded(chainage_on(df, "node", [(0.0, 0.0), (2500.0, 1500.0), (5000.0, 5000.0)]), "chain", "dist")

