"""Queries of frames, lattices, sections, buffers, records and of sources and sinks that no other query uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import components as C
from gridloom.operators import decisions as D
from gridloom.operators import frames as R
from gridloom.operators import gates as G
from gridloom.operators import joins as J
from gridloom.operators import learning as L
from gridloom.operators.grid import point_in_polygon
from gridloom.plans.cells import rounded
from gridloom.plans.learning import labelled
from gridloom.plans.registry import fixture, query, table
from gridloom.sources import readers, sinks
from gridloom.staging import shared_dir


@query("tide_term", "WITH t AS (SELECT node, 46 + y / 10000 AS lat, 0.06029 - 0.180873 * sin(radians(46 + y / 10000)) * sin(radians(46 + y / 10000)) AS t FROM nodes) SELECT node, round(t, 9) AS term, round((SELECT avg(0.2 - t) FROM t), 9) AS closure FROM t", on="nodes")
def tide_term(df):
    """The permanent tide at each node and the mean closure of a chain of 0.2 m over all of them."""
    t = df.select("node", R.free_to_mean(46 + F.col("y") / 10000).alias("term"))
    return rounded(t.join(F.broadcast(t.agg(F.avg(0.2 - F.col("term")).alias("closure")))), "term", "closure", digits=9)  # one row


_DATUM = "CASE {k} % 4 WHEN 0 THEN 'EVRF2019' WHEN 1 THEN 'evrf 2019' WHEN 2 THEN 'EVRF-2019' ELSE CASE WHEN {g} < 2 THEN 'EVRF_2019' WHEN {g} = 2 THEN NULL ELSE 'EGM2008' END END"


@query("vertical_frames", f"WITH d AS (SELECT n_regionkey AS region, nullif(upper(regexp_replace({_DATUM.format(k='n_nationkey', g='n_regionkey')}, '[\\s_-]+', '', 'g')), '') AS d FROM nation) SELECT region, CASE WHEN count(*) = count(d) AND min(d) = max(d) THEN min(d) END AS frame, count(*) - count(d) AS undeclared, coalesce(count(*) = count(d) AND min(d) = max(d), false) AS same FROM d GROUP BY region")
def vertical_frames(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.expr(_DATUM.format(k="n_nationkey", g="n_regionkey")).alias("datum"))
    return R.vertical_frames(n, ["region"])


@query("crs_guard", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'geographic' WHEN 2 THEN 'other' ELSE 'missing' END AS status FROM nation")
def crs_guard(spark, sf):
    crs = F.when(F.col("n_nationkey") % 4 == 0, "epsg:32636").when(F.col("n_nationkey") % 4 == 1, "EPSG:4326").when(F.col("n_nationkey") % 4 == 2, "EPSG:32635")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), R.crs_status(crs, "EPSG:32636").alias("status"))


_BOUNDS = "b AS (SELECT river, min(x) + 1000 AS a, max(x) + 1000 AS b, min(y) AS c, max(y) AS d FROM nodes GROUP BY river), g AS (SELECT river, floor(a / 70) * 70 AS x0, floor(c / 70) * 70 AS y0, (floor(b / 70) + 1) * 70 AS x1, (floor(d / 70) + 1) * 70 AS y1 FROM b)"


@query("domain_grid", f"WITH {_BOUNDS} SELECT river, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, round((x1 - x0) / 70)::BIGINT AS nx, round((y1 - y0) / 70)::BIGINT AS ny FROM g", on="nodes")
def domain_grid(df):
    return R.grid_of(df.withColumn("x", F.col("x") + 1000), 70.0, ["river"])


@query("domain_coverage", f"WITH {_BOUNDS} SELECT river, greatest(x0 - a, 0)::DOUBLE AS west, greatest(b - (x1 - 140), 0)::DOUBLE AS east, greatest(y0 + 35 - c, 0)::DOUBLE AS south, greatest(d - y1, 0)::DOUBLE AS north, false AS covered FROM g JOIN b USING (river)", on="nodes")
def domain_coverage(df):
    """A grid cut short in the east and south against the points that it claims to hold."""
    x = df.withColumn("x", F.col("x") + 1000)
    short = R.grid_of(x, 70.0, ["river"]).withColumns({"x1": F.col("x1") - 140, "y0": F.col("y0") + 35})
    return R.shortfall(short, x, ["river"])


@query("lattice_alignment", "SELECT s_suppkey AS id, (s_suppkey * 10 + s_nationkey % 3 * 5) % 10 = 0 AS aligned FROM supplier")
def lattice_alignment(spark, sf):
    x0 = (F.col("s_suppkey") * 10 + F.col("s_nationkey") % 3 * 5).cast("double")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), R.aligned(x0, F.lit(500.0), F.lit(300.0), F.lit(900.0), 10.0).alias("aligned"))


@query("coarse_clip", "WITH f AS (SELECT s_suppkey AS id, s_suppkey * 10.0 AS x0, s_suppkey * 10.0 + 330 AS x1, s_nationkey * 10.0 AS y0, s_nationkey * 10.0 + 450 AS y1 FROM supplier), g AS (SELECT *, floor(x0 / 20) * 20 AS cx0, ceil(x1 / 20) * 20 AS cx1, floor(y0 / 20) * 20 AS cy0, ceil(y1 / 20) * 20 AS cy1 FROM f) SELECT id, ((cx1 - cx0) / 20)::BIGINT AS nx, ((cy1 - cy0) / 20)::BIGINT AS ny, (round((x0 - cx0) / 10)::BIGINT % 2) AS phase_cols, (round((cy1 - y1) / 10)::BIGINT % 2) AS phase_rows FROM g")
def coarse_clip(spark, sf):
    x, y = F.col("s_suppkey") * 10.0, F.col("s_nationkey") * 10.0
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("x0"), (x + 330).alias("x1"), y.alias("y0"), (y + 450).alias("y1"))
    return R.coarse_clip(f, 10.0).select("id", "nx", "ny", "phase_cols", "phase_rows")


@query("cross_sections", "WITH p AS (SELECT r AS section, c - (SELECT max(c) FROM cells) // 2 AS k, dem AS z, unnest([20.0, 26.0, 32.0]::DOUBLE[]) AS level FROM cells), e AS (SELECT section, level, coalesce(max(k) FILTER (k <= 0 AND z >= level), -99) AS lo, coalesce(min(k) FILTER (k >= 0 AND z >= level), 99) AS hi FROM p GROUP BY ALL) SELECT section, level, (count(*) FILTER (k > lo AND k < hi AND lo < 0) * 20.0)::DOUBLE AS width, round(coalesce(sum(level - z) FILTER (k > lo AND k < hi AND lo < 0), 0) * 20, 6) AS area FROM p JOIN e USING (section, level) GROUP BY ALL", on="cells")
def cross_sections(df):
    """Each row of the lattice as a section through its middle column."""
    middle = df.agg(F.floor(F.max("c") / 2).alias("m"))
    p = df.join(F.broadcast(middle)).select(F.col("r").alias("section"), (F.col("c") - F.col("m")).alias("k"), F.col("dem").alias("z"))  # one row
    return rounded(R.cross_sections(p, [20.0, 26.0, 32.0], 20.0), "area")


@query("block_buffer", "WITH a AS (SELECT r, c, (r // 8 + c // 8) % 3 + 1 AS role FROM cells) SELECT a.r, a.c, CASE WHEN min(b.role) = max(b.role) THEN a.role ELSE 4 END AS final FROM a JOIN a b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.r, a.c, a.role", on="cells")
def block_buffer(df):
    role = (F.floor(F.col("r") / 8) + F.floor(F.col("c") / 8)) % 3 + 1
    return R.buffered_roles(df.select("r", "c", role.alias("role")), "role", 2, 4).select("r", "c", "final")


@query("zonal_connection", "WITH RECURSIVE m AS (SELECT r, c, c // 10 AS own FROM cells WHERE dem < 27), reach AS (SELECT r, c, own FROM m WHERE c % 10 = 0 AND r = 20 UNION SELECT m.r, m.c, m.own FROM reach a JOIN m ON a.own = m.own AND abs(a.r - m.r) <= 1 AND abs(a.c - m.c) <= 1) SELECT own, r, c FROM reach", on="cells")
def zonal_connection(df):
    """The superseded evaluation, each zone on its own, against which seams are checked."""
    m = df.filter("dem < 27").select("r", "c", F.floor(F.col("c") / 10).alias("own"))
    return C.connected_to(m, m.filter("c % 10 = 0 AND r = 20"), by=["own"], tile=16).select("own", "r", "c")


@query("mask_overlay", "WITH a AS (SELECT r, c FROM cells WHERE ground = 1), b AS (SELECT r, c FROM cells WHERE wc = 3), d AS (SELECT a.r, a.c, min(sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS d FROM a JOIN b ON abs(a.r - b.r) <= 6 AND abs(a.c - b.c) <= 6 GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (d = 0) AS inside, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM a LEFT JOIN d USING (r, c) WHERE d IS NULL OR d <= 6", on="cells")
def mask_overlay(df):
    """Cells of one shape: how many are inside another, and the least and greatest distance to it, within six cells."""
    a = df.filter("ground = 1").select("r", "c", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    b = df.filter("wc = 3").select((F.col("r") * 1000 + F.col("c")).alias("node"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    d = a.join(J.nearest(a, b, 1, 6.0, ["r", "c"], "node").select("r", "c", "distance"), ["r", "c"], "left")
    return rounded(d.agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 0).alias("inside"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest")), "nearest", "farthest")


@query("context_classes", "SELECT r, c, CASE WHEN hand > 40 THEN 'hard' WHEN wc IN (5, 6) THEN 'storage' WHEN ground IN (1, 2) THEN 'open' ELSE 'other' END AS context FROM cells", on="cells")
def context_classes(df):
    """Lists of classes in rising priority: the last that applies holds."""
    ordered = [(F.col("ground").isin(1, 2), "open"), (F.col("wc").isin(5, 6), "storage"), (F.col("hand") > 40, "hard")]
    return df.select("r", "c", D.first_wins(list(reversed(ordered)), "other").alias("context"))


@query("json_manifest", "SELECT river, count(*) AS n, round(sum(x), 6) AS x FROM nodes GROUP BY river", on="nodes")
def json_manifest(df):
    """A manifest written as JSON lines and read back by schema."""
    path = f"{shared_dir(df.sparkSession)}/manifest"
    df.groupBy("river").agg(F.count("*").alias("n"), F.sum("x").alias("x")).write.json(path)
    return rounded(df.sparkSession.read.schema("river string, n long, x double").json(path), "x")


@query("yearbook_daily", "SELECT node, day, h FROM node_day", on="node_day")
def yearbook_daily(df):
    """A yearbook page per node (a row per day of the month, a column per month) and back into daily values."""
    dated = df.withColumns({"year": F.year("day"), "d": F.dayofmonth("day"), "month": F.month("day")})
    wide = dated.groupBy("node", "year", "d").pivot("month", list(range(1, 13))).agg(F.first("h"))
    return readers.yearbook(wide, ["node"])


@query("feature_exclusion", "SELECT r, c, dem FROM cells", on="cells")
def feature_exclusion(df):
    return df.select("r", "c", *G.kept_features(["dem", "hand", "n", "ground", "wc", "score"], r"^(?:hand|n)$|score|ground|^wc"))


@query("stage_order", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + k AS b FROM nation, (SELECT unnest([3, 7]) AS k) WHERE n_nationkey + k < 25), p AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT e.b, p.level + 1 FROM p JOIN e ON e.a = p.node) SELECT node, max(level) AS level FROM p GROUP BY node")
def stage_order(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.lit(3), F.lit(7))).alias("k"))
    return R.stage_order(n.select(F.col("n_nationkey").alias("before"), (F.col("n_nationkey") + F.col("k")).alias("after")).filter("after < 25"))


@query("freeze_record", "SELECT n_regionkey AS part, count(*) AS n, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey)) AS digest, n_regionkey <> 2 AS frozen FROM nation GROUP BY n_regionkey")
def freeze_record(spark, sf):
    """Digests of outputs against those recorded at the freeze; one part was changed since."""
    n = table(spark, sf, "nation")
    now = G.digests(n, ["n_regionkey"], F.concat_ws(":", "n_nationkey", "n_name"), "n_nationkey")
    then = G.digests(n.withColumn("n_name", F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0), "x").otherwise(F.col("n_name"))), ["n_regionkey"], F.concat_ws(":", "n_nationkey", "n_name"), "n_nationkey")
    return G.frozen(now, then, ["n_regionkey"]).withColumnRenamed("n_regionkey", "part")


@query("rederived_difference", "WITH a AS (SELECT ground, count(*) AS n FROM cells GROUP BY ground), b AS (SELECT ground, n + (ground = 3)::INT AS n FROM a) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", on="cells")
def rederived_difference(df):
    """A published table against the same one derived again: rows that either side lacks."""
    a = df.groupBy("ground").agg(F.count("*").alias("n"))
    return G.same_rows(a, a.withColumn("n", F.col("n") + (F.col("ground") == 3).cast("int")))


@query("reproduction_gate", "SELECT region, round(sum(area), 6) AS measured, round(sum(area) + region * 0.04, 6) AS stored, region * 0.04 <= 0.1 AS holds FROM draws GROUP BY region", on="draws")
def reproduction_gate(df):
    a = df.groupBy("region").agg(F.sum("area").alias("measured"))
    return rounded(G.within(a.withColumn("stored", F.col("measured") + F.col("region") * 0.04), "measured", "stored", 0.1), "measured", "stored")


_FREEZE = """WITH s AS (SELECT r, c, count(*) AS n, min(b08) AS lo, median(b08) AS mid, max(b08) AS hi, count(*) FILTER (scl IN (3, 8)) AS rejected FROM stack GROUP BY r, c),
 g AS (SELECT * FROM (VALUES ('duplicates', (SELECT count(*) - count(DISTINCT (scene, line)) FROM stack)), ('cells', (SELECT abs(count(*) - (SELECT count(*) FROM cells)) FROM s)), ('order', (SELECT count(*) FROM s WHERE NOT (lo <= mid AND mid <= hi))),
  ('observations', (SELECT count(*) FROM s WHERE rejected > n)), ('range', (SELECT count(*) FROM stack WHERE b08 NOT BETWEEN 0 AND 3.2767)), ('finite', (SELECT count(*) FROM stack WHERE b08 IS NULL OR isnan(b08))), ('windows', (SELECT count(*) FROM stack WHERE win NOT IN ('pre', 'event', 'trace'))),
  ('recount', (SELECT abs(sum(n) - (SELECT count(*) FROM stack)) FROM s)), ('agreement', (SELECT count(*) FROM s JOIN cells USING (r, c) WHERE s.n <> cells.n))) AS t(gate, measured))
 SELECT gate, measured::DOUBLE AS measured, 0::DOUBLE AS expected, CASE WHEN measured = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g"""


@query("composite_freeze_gates", _FREEZE)
def composite_freeze_gates(spark, sf):
    """Nine gates of a composite: inventory, coverage, order of its statistics, ranges, windows and recounts; each counts what breaks it."""
    stack, cells = fixture(spark, sf, "stack"), fixture(spark, sf, "cells")
    s = stack.groupBy("r", "c").agg(F.count("*").alias("n"), F.min("b08").alias("lo"), F.median("b08").alias("mid"), F.max("b08").alias("hi"), F.count_if(F.col("scl").isin(3, 8)).alias("rejected"))
    one = lambda df, c: df.agg(c.cast("double").alias("m"))
    gap = lambda a, b: a.join(F.broadcast(b)).select(F.abs(F.col("a") - F.col("b")).cast("double"))  # noqa: E731 - one row each
    return G.gate_table(spark, {
        "duplicates": (one(stack, F.count("*") - F.count_distinct("scene", "line")), 0.0),
        "cells": (gap(s.agg(F.count("*").alias("a")), cells.agg(F.count("*").alias("b"))), 0.0),
        "order": (one(s, F.count_if(~((F.col("lo") <= F.col("mid")) & (F.col("mid") <= F.col("hi"))))), 0.0),
        "observations": (one(s, F.count_if(F.col("rejected") > F.col("n"))), 0.0),
        "range": (one(stack, F.count_if(~F.col("b08").between(0, 3.2767))), 0.0),
        "finite": (one(stack, F.count_if(F.col("b08").isNull() | F.isnan("b08"))), 0.0),
        "windows": (one(stack, F.count_if(~F.col("win").isin("pre", "event", "trace"))), 0.0),
        "recount": (gap(s.agg(F.sum("n").alias("a")), stack.agg(F.count("*").alias("b"))), 0.0),
        "agreement": (one(s.join(cells.select("r", "c", F.col("n").alias("m")), ["r", "c"]), F.count_if(F.col("n") != F.col("m"))), 0.0),
    })


@query("support_distance", "SELECT node, CASE WHEN x / 400 <= 3 THEN 'near' WHEN x / 400 <= 10 THEN 'middle' ELSE 'far' END AS support FROM nodes", on="nodes")
def support_distance(df):
    return df.select("node", D.support_distance_class(F.col("x") / 400).alias("support"))


@query("retained_verdicts", "SELECT r, c, CASE WHEN ground <> 1 THEN '' WHEN wc = 0 THEN 'RETAINED_PLAUSIBLE' WHEN wc = 1 THEN 'LIKELY_DRAINED' ELSE 'RETAINED_UNCERTAIN' END AS verdict FROM cells", on="cells")
def retained_verdicts(df):
    flag = F.when(F.col("wc") == 0, "S1_WATER").when(F.col("wc") == 1, "S1_OPEN_SURFACE_NO_WATER").otherwise("S1_INCONCLUSIVE")
    return df.select("r", "c", D.retained_verdict(F.when(F.col("ground") == 1, "TRAPPED").otherwise("OPEN"), flag).alias("verdict"))


@query("tiled_store", "SELECT r::INT AS r, c::INT AS c, round(round_even(dem * 100, 0) / 100, 4) AS dem FROM cells WHERE r BETWEEN 5 AND 20", on="cells")
def tiled_store(df):
    """Cells written by tile and read by row window, wanted bands only."""
    path = f"{shared_dir(df.sparkSession)}/tiled"
    sinks.write_cells(df.select(F.lit("g").alias("grid_id"), F.col("r").cast("int"), F.col("c").cast("int"), F.rint(F.col("dem") * 100).cast("int").alias("dem"), "hand"), path, tile=16)
    return rounded(readers.cell_table(readers.require_column(df.sparkSession.read.parquet(path), "grid_id").sparkSession, path, ["dem"], (5, 20), scale=100.0).select("r", "c", "dem"), "dem", digits=4)


@query("version_ledger", "SELECT id, v FROM (SELECT o_orderkey % 100 AS id, o_orderkey AS v, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def version_ledger(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("id"), F.col("o_orderkey").alias("v"))
    return sinks.ledger(o.filter("v % 2 = 0"), o.filter("v % 2 = 1"), ["id"], "v")


@query("tagged_manifest", "SELECT count(*) AS n, 'nodes' AS name, '7' AS seed FROM nodes", on="nodes")
def tagged_manifest(df):
    m = sinks.manifest(df, {"name": "nodes", "seed": "7"}).select(F.from_json("manifest", "n long, checksum long, name string, seed string").alias("m"))
    return m.select("m.n", "m.name", "m.seed")


@query("ascii_grid", "SELECT r::INT AS r, c::INT AS c, CASE WHEN ground <> 2 THEN dem END AS z FROM cells", on="cells")
def ascii_grid(df):
    """The lattice as an ESRI ASCII grid and back; cells of one class are the sentinel."""
    folder = f"{shared_dir(df.sparkSession)}/grid"
    every = df.select("r", "c", F.when(F.col("ground") == 2, -9999.0).otherwise(F.col("dem")).alias("z"))
    sinks.ascii_grid(every, folder, 20.0)
    z, _ = readers.esri_grid(df.sparkSession, folder)
    return z.select(F.col("r").cast("int"), F.col("c").cast("int"), "z").join(df.select(F.col("r").cast("int"), F.col("c").cast("int")), ["r", "c"], "left_semi")


@query("polygon_rings", "SELECT r, c FROM cells WHERE c + 0.5 > 5 AND c + 0.5 < 25 AND r + 0.5 > 5 AND r + 0.5 < 5 + (25 - (c + 0.5))", on="cells")
def polygon_rings(df):
    """Rings of all GeoJSON documents under a path, as a point-in-polygon test."""
    path, text = f"{shared_dir(df.sparkSession)}/rings", '{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[5, 5], [25, 5], [5, 25], [5, 5]]]}}]}'
    df.sparkSession.sql("SELECT 1").select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    inside = F.lit(False)
    for ring in readers.rings(df.sparkSession, path):
        inside = inside | point_in_polygon(F.col("c") + 0.5, F.col("r") + 0.5, ring)
    return df.filter(inside).select("r", "c")


@query("chosen_parameters", None, on="cells")
def chosen_parameters(df):
    """The grid's forests by median inner average precision over the folds."""
    return L.choose(labelled(df).withColumnRenamed("score", "s"), ["dem", "hand"], "y", "inner", 2, [(5, 2), (5, 4)]).withColumn("median_ap", F.round("median_ap", 6))


@query("feature_importances", None, on="cells")
def feature_importances(df):
    return L.importances(labelled(df).withColumnRenamed("score", "s"), ["dem", "hand", "s"], "y", trees=10, depth=4).withColumn("importance", F.round("importance", 6))


@query("transfer_between_frames", None, on="cells")
def transfer_between_frames(df):
    """Learn in one half of the lattice, judge in the other, both ways."""
    return L.transfer(labelled(df).withColumnRenamed("score", "s"), ["dem", "hand"], "y", "outer", trees=10, depth=4).withColumn("ap", F.round("ap", 6))


@query("surface_forest", None, on="cells")
def surface_forest(df):
    """A forest of all ground classes; below a probability of one half the class is uncertain."""
    x = df.select("r", "c", "dem", "hand", "score", F.col("ground"))
    return L.surface_classes(x, ["dem", "hand"], "ground", least=0.5, trees=10, depth=4).select("r", "c", "surface", F.round("probability", 6).alias("probability"))
