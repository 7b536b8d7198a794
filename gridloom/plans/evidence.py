"""Queries of evidence bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import components as C
from gridloom.operators import evidence as V
from gridloom.operators import indices as I
from gridloom.plans.cells import _VALID, rounded
from gridloom.plans.lattice import _LABEL, _TILE, low
from gridloom.plans.registry import fixture, query


@query("corrected_ground", "SELECT r, c, ground, round(dem - coalesce(bias, 0), 6) AS dem FROM cells LEFT JOIN (VALUES (1, 0.25::DOUBLE), (2, -0.1::DOUBLE)) b(ground, bias) USING (ground)", on="cells")
def corrected_ground(df):
    biases = df.sparkSession.createDataFrame([(1, 0.25), (2, -0.1)], "ground int, bias double")
    return rounded(V.corrected_ground(df, biases, "ground").select("r", "c", "ground", "dem"), "dem")


@query("standardised_context", "WITH x AS (SELECT r, c, ground, CASE WHEN wc <> 3 THEN dem END AS x FROM cells), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM x) SELECT r, c, round(CASE WHEN x IS NULL THEN 0 ELSE least(greatest((x - m) / CASE WHEN b - a < 1e-6 THEN 1 ELSE b - a END, -1.5), 1.5) END, 6) AS z_x, (x IS NOT NULL)::INT AS has_x, (ground = 1)::INT AS is_bare, (ground = 2)::INT AS is_crop FROM x, q", on="cells")
def standardised_context(df):
    x = df.select("r", "c", "ground", F.when(F.col("wc") != 3, F.col("dem")).alias("x"))
    z = V.standardised(x, ["x"], 1.5).withColumns(V.one_hot("ground", {"is_bare": 1, "is_crop": 2}))
    return rounded(z.select("r", "c", "z_x", "has_x", "is_bare", "is_crop"), "z_x")


@query("level_tables", "SELECT r // 10 AS block_r, c // 10 AS block_c, level, count(*) FILTER (dem < level) * 400.0::DOUBLE AS area, round(sum(CASE WHEN dem < level THEN level - dem ELSE 0 END) * 400.0::DOUBLE, 6) AS volume FROM cells, (SELECT unnest([20.25, 25.25, 30.25]::DOUBLE[]) AS level) GROUP BY ALL", on="cells")
def level_tables(df):
    return rounded(V.level_tables(df, 10, [20.25, 25.25, 30.25], 400.0), "volume")


@query("sensor_status", "SELECT r, c, CASE WHEN ground = 1 AND n % 2 = 1 THEN 3 WHEN ground = 1 THEN 2 WHEN wc % 2 = 1 AND n % 2 = 1 THEN 5 WHEN wc % 2 = 1 THEN 4 WHEN n % 2 = 1 THEN 1 ELSE 0 END AS status FROM cells", on="cells")
def sensor_status(df):
    return df.select("r", "c", V.sensor_status(F.col("n") % 2 == 1, F.col("ground") == 1, F.col("wc") % 2 == 1).alias("status"))


@query("observation_bins", "SELECT wc, count(*) AS n, count(*) FILTER (n BETWEEN 0 AND 3) AS n_few, round(100 * avg((n BETWEEN 0 AND 3)::INT), 6) AS pct_few, count(*) FILTER (n BETWEEN 4 AND 999) AS n_many, round(100 * avg((n BETWEEN 4 AND 999)::INT), 6) AS pct_many FROM cells GROUP BY wc", on="cells")
def observation_bins(df):
    return rounded(V.observation_bins(df, "n", {"few": (0, 3), "many": (4, 999)}, ["wc"]), "pct_few", "pct_many")


@query("label_tiers", "WITH a AS (SELECT r, c, CASE WHEN wc < 5 THEN wc % 3 END AS own FROM cells WHERE c < 25), b AS (SELECT r, c, CASE WHEN wc <> 2 THEN ground % 2 END AS other FROM cells WHERE c >= 10) SELECT r, c, CASE WHEN own = 0 AND other = 0 THEN 2 WHEN own = 1 AND other = 1 THEN 3 WHEN own + other = 1 AND own IN (0, 1) THEN 4 WHEN own IS NOT NULL THEN 1 ELSE 0 END AS tier FROM a LEFT JOIN b USING (r, c)", on="cells")
def label_tiers(df):
    own = df.filter("c < 25").select("r", "c", F.when(F.col("wc") < 5, F.col("wc") % 3).alias("own"))
    other = df.filter("c >= 10").select("r", "c", F.when(F.col("wc") != 2, F.col("ground") % 2).alias("other"))
    return own.join(other, ["r", "c"], "left").select("r", "c", V.label_tier(F.col("own"), F.col("other")).alias("tier"))


_FOOT = "f AS (SELECT r, c, CASE WHEN c < 18 THEN 'train' WHEN c < 26 THEN 'val' ELSE 'test' END AS role FROM cells WHERE r % 6 = 0 AND c % 5 = 0)"


@query("split_leaks", f"WITH {_FOOT.replace(' WHERE r % 6 = 0 AND c % 5 = 0', '')} SELECT a.r AS ar, a.c AS ac, a.role AS a_role, b.r AS br, b.c AS bc, b.role AS b_role FROM f a JOIN f b ON a.role < b.role AND abs(a.r - b.r) < 7 AND abs(a.c - b.c) < 7", on="cells")
def split_leaks(df):
    """A footprint at every cell."""
    role = F.when(F.col("c") < 18, "train").when(F.col("c") < 26, "val").otherwise("test")
    return V.leaks(df.select("r", "c", role.alias("role")), 4, 3)


@query("ring_context", "WITH m AS (SELECT r, c FROM cells WHERE dem < 12), g AS (SELECT * FROM cells x WHERE NOT dem < 12 AND EXISTS (FROM m WHERE abs(m.r - x.r) <= 2 AND abs(m.c - x.c) <= 2)) SELECT ground, count(*) AS n, round(avg(dem), 6) AS dem, round(median(hand), 6) AS hand FROM g GROUP BY ground", on="cells")
def ring_context(df):
    x = V.ring(df.filter("dem < 12").select("r", "c"), 2).join(df, ["r", "c"])
    return rounded(x.groupBy("ground").agg(F.count("*").alias("n"), F.avg("dem").alias("dem"), F.median("hand").alias("hand")), "dem", "hand")


@query("evidence_inventory", f"WITH s AS (SELECT r, c, wc % 3 AS stratum FROM cells), t AS (SELECT stratum, count(*) AS n_cells FROM s GROUP BY stratum), o AS (SELECT DISTINCT win, day, stratum, r, c FROM stack JOIN s USING (r, c) WHERE {_VALID}), d AS (SELECT win, stratum, day, count(*) AS k FROM o GROUP BY ALL), u AS (SELECT win, stratum, count(DISTINCT r * 1000 + c) AS n_any FROM o GROUP BY ALL) SELECT win, stratum, n_cells, count(*) AS n_scenes, min(day) AS \"first\", max(day) AS \"last\", round(any_value(n_any) / n_cells, 6) AS share_any, round(avg(k) / n_cells, 6) AS mean_share, arg_min(day, (-k, day)) AS best_scene, round(max(k) / n_cells, 6) AS best_share FROM d JOIN u USING (win, stratum) JOIN t USING (stratum) GROUP BY win, stratum, n_cells")
def evidence_inventory(spark, sf):
    seen = fixture(spark, sf, "stack").filter(I.is_valid(F.col("scl"), F.col("b03"))).select("r", "c", "win", "day")
    strata = fixture(spark, sf, "cells").select("r", "c", (F.col("wc") % 3).alias("stratum"))
    return rounded(V.inventory(seen, strata, "win", "day"), "share_any", "mean_share", "best_share")


_FIELD = "WITH b AS (SELECT r // 4 AS br, c // 4 AS bc, avg((wc = 0)::INT) AS water, avg(CASE WHEN ground = 1 THEN score END) / 10 AS rb, avg(score) / 0.8 AS rp, max(score) / 3 AS ra, min(hand) <= 15 AS conn, median(dem) < 25 AS wet, median(dem) < 27 AS moist, count(*) > 13 AS seen FROM cells GROUP BY ALL)"


@query("candidate_groups", f"{_FIELD} SELECT br, bc, CASE WHEN coalesce(water >= 0.2, false) OR coalesce(rb >= 0.3, false) THEN 'A' WHEN rp >= 0.5 AND coalesce(rb < 0.1, false) AND conn AND (wet OR NOT seen) THEN 'C' WHEN (ra >= 0.3 OR moist) AND NOT conn THEN 'B' ELSE 'D' END AS grp FROM b", on="cells")
def candidate_groups(df):
    b = df.groupBy(F.floor(F.col("r") / 4).alias("br"), F.floor(F.col("c") / 4).alias("bc")).agg(
        F.avg((F.col("wc") == 0).cast("int")).alias("water"), (F.avg(F.when(F.col("ground") == 1, F.col("score"))) / 10).alias("rb"), (F.avg("score") / 0.8).alias("rp"), (F.max("score") / 3).alias("ra"),
        (F.min("hand") <= 15).alias("conn"), (F.median("dem") < 25).alias("wet"), (F.median("dem") < 27).alias("moist"), (F.count("*") > 13).alias("seen"),
    )
    return b.select("br", "bc", V.candidate_group(*(F.col(k) for k in ("water", "rb", "rp", "ra", "conn", "wet", "moist", "seen"))).alias("grp"))


_ND16 = "round_even(median((b08 - b04) / nullif(b08 + b04, 0)) FILTER (win = '{w}') * 10000, 0)::INT"


@query("index_change_sanity", f"WITH m AS (SELECT r, c, {_ND16.format(w='event')} AS e, {_ND16.format(w='pre')} AS p FROM stack GROUP BY r, c), d AS (SELECT r % 4 AS band, least(greatest(e - p, -32767), 32767) AS d, e, p FROM m) SELECT band, round(coalesce(avg(CASE WHEN e IS NOT NULL AND p IS NOT NULL THEN (abs(e - p) >= 32767)::INT END), 0), 6) AS at_limit, round(coalesce(avg(CASE WHEN e IS NOT NULL AND p IS NOT NULL THEN (abs(d) > 20000)::INT END), 0), 6) AS over_two, coalesce(avg((abs(e - p) >= 32767)::INT), 0) < 1e-3 AND coalesce(avg((abs(e - p) > 20000)::INT), 0) < 1e-2 AS ok FROM d GROUP BY band", on="stack")
def index_change_sanity(df):
    nd = I.normalized_difference(F.col("b08"), F.col("b04"))
    m = df.groupBy("r", "c").agg(*(I.to_scaled(F.median(F.when(F.col("win") == w, nd))).alias(w) for w in ("event", "pre")))
    d = m.select((F.col("r") % 4).alias("band"), F.when(F.col("event").isNotNull() & F.col("pre").isNotNull(), V.delta(F.col("event"), F.col("pre"))).alias("d"))
    return rounded(V.delta_sanity(d, "d", ["band"]), "at_limit", "over_two")


@query("burn_strata", "WITH m AS (SELECT r, c, median((b08 - b12) / nullif(b08 + b12, 0)) FILTER (win = 'pre') - median((b08 - b12) / nullif(b08 + b12, 0)) FILTER (win = 'event') AS dnbr FROM stack GROUP BY r, c), x AS (SELECT *, CASE WHEN dnbr IS NOT NULL THEN dnbr > 0.1003 END AS burnt FROM cells JOIN m USING (r, c)), s AS (SELECT 'trees_unburnt' AS stratum, dem FROM x WHERE wc = 1 AND NOT burnt UNION ALL SELECT 'grass_unburnt', dem FROM x WHERE wc IN (2, 3) AND NOT burnt UNION ALL SELECT 'burnt', dem FROM x WHERE burnt UNION ALL SELECT 'all_trees', dem FROM x WHERE wc = 1) SELECT stratum, count(*) AS n, round(avg(dem), 6) AS mean FROM s GROUP BY stratum")
def burn_strata(spark, sf):
    ratio = I.normalized_difference(F.col("b08"), F.col("b12"))
    at = lambda w: F.median(F.when(F.col("win") == w, ratio))
    change = fixture(spark, sf, "stack").groupBy("r", "c").agg((at("pre") - at("event")).alias("dnbr"))
    x = fixture(spark, sf, "cells").join(change, ["r", "c"])
    burnt, trees = F.col("dnbr") > 0.1003, F.col("wc") == 1
    strata = {"trees_unburnt": trees & ~burnt, "grass_unburnt": F.col("wc").isin(2, 3) & ~burnt, "burnt": burnt, "all_trees": trees}
    return rounded(V.strata_shares(x, strata, [], F.col("dem")), "mean")


_BOUNDED = "o AS (SELECT node, day, CASE WHEN dayofmonth(day) % 5 <> 0 THEN h END AS obs, CASE WHEN dayofmonth(day) % 5 = 0 THEN h * 0.8 END AS bound, h AS filled FROM node_day WHERE dayofmonth(day) % 3 <> 1), s AS (SELECT node, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM (SELECT node, min(day) AS a, max(day) AS b FROM o GROUP BY node)), x AS (SELECT s.node, s.day, obs, bound, filled FROM s LEFT JOIN o ON o.node = s.node AND o.day = s.day)"


@query("bounded_series", f"WITH {_BOUNDED}, w AS (SELECT *, last_value(CASE WHEN obs IS NOT NULL THEN {{'d': day, 'x': obs}} END IGNORE NULLS) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN obs IS NOT NULL OR bound IS NOT NULL THEN {{'d': day, 'x': bound, 'k': obs IS NULL}} END IGNORE NULLS) OVER (PARTITION BY node ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM x) SELECT node, day, round(CASE WHEN bound IS NOT NULL THEN least(filled, bound) WHEN obs IS NULL AND l IS NOT NULL AND coalesce(n.k, false) AND n.d - l.d <= 3 THEN l.x + (n.x - l.x) * (day - l.d) / (n.d - l.d) ELSE filled END, 6) AS h FROM w")
def bounded_series(spark, sf):
    day = F.dayofmonth("day")
    o = fixture(spark, sf, "node_day").filter(day % 3 != 1).select("node", "day", F.when(day % 5 != 0, F.col("h")).alias("obs"), F.when(day % 5 == 0, F.col("h") * 0.8).alias("bound"), F.col("h").alias("filled"))
    days = o.groupBy("node").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    x = V.capped_by_bounds(days.join(o, ["node", "day"], "left"), "node", "day", "filled", "obs", "bound")
    return rounded(x.select("node", "day", F.col("filled").alias("h")), "h")


@query("isolated_components", f"WITH RECURSIVE {_LABEL}, k AS (SELECT k, count(*) AS n, avg((ground = 1)::INT) AS crop, bool_or(wc = 0) AS flooded FROM lab JOIN cells USING (r, c) GROUP BY k) SELECT k // 1000 AS comp_r, k % 1000 AS comp_c, n, round(crop, 6) AS crop FROM k WHERE n >= 2 AND crop >= 0.25 AND NOT flooded", on="cells")
def isolated_components(df):
    x = C.label(low(df), 8, tile=_TILE).join(df, ["r", "c"])
    rule = (F.col("n") >= 2) & (F.col("crop") >= 0.25) & ~F.col("flooded")
    return rounded(V.component_rule(x, {"crop": F.avg((F.col("ground") == 1).cast("int")), "flooded": F.bool_or(F.col("wc") == 0)}, rule).drop("flooded"), "crop")


@query("depressions", f"WITH RECURSIVE {_LABEL}, k AS (SELECT k, count(*) AS n, 25 - min(dem) AS deepest, bool_or(wc = 1) AS reached, max(dem) AS sill, median(hand) AS level FROM lab JOIN cells USING (r, c) GROUP BY k) SELECT k // 1000 AS comp_r, k % 1000 AS comp_c, n, round(deepest, 6) AS deepest, round(sill, 6) AS sill, round(level, 6) AS level FROM k WHERE n >= 2 AND deepest >= 2 AND reached AND sill > level - 31", on="cells")
def depressions(df):
    """Connected low ground that is large, deep and reached, with a rim above the level before."""
    x = C.label(low(df), 8, tile=_TILE).join(df, ["r", "c"])
    rule = (F.col("n") >= 2) & (F.col("deepest") >= 2) & F.col("reached") & (F.col("sill") > F.col("level") - 31)
    figures = {"deepest": 25 - F.min("dem"), "reached": F.bool_or(F.col("wc") == 1), "sill": F.max("dem"), "level": F.median("hand")}
    return rounded(V.component_rule(x, figures, rule).drop("reached"), "deepest", "sill", "level")


@query("components_over_area", f"WITH RECURSIVE {_LABEL} SELECT r, c FROM lab WHERE k IN (SELECT k FROM lab GROUP BY k HAVING count(*) >= 3)", on="cells")
def components_over_area(df):
    x = C.label(low(df), 8, tile=_TILE)
    return x.join(V.component_rule(x, {}, F.col("n") >= 3), ["comp_r", "comp_c"], "left_semi").select("r", "c")


@query("surface_or_uncertain", "WITH p AS (SELECT r, c, CASE WHEN wc <> 6 THEN dem / (dem + hand + n) END AS a, CASE WHEN wc <> 6 THEN hand / (dem + hand + n) END AS b, CASE WHEN wc <> 6 THEN n / (dem + hand + n) END AS d FROM cells) SELECT r, c, CASE WHEN a IS NULL THEN NULL WHEN greatest(a, b, d) < 0.4503 THEN 'UNCERTAIN' WHEN a >= b AND a >= d THEN 'WATER' WHEN b >= d THEN 'CROP' ELSE 'BARE' END AS cls FROM p", on="cells")
def surface_or_uncertain(df):
    total = F.col("dem") + F.col("hand") + F.col("n")
    p = F.when(F.col("wc") != 6, F.array(*(F.col(k) / total for k in ("dem", "hand", "n"))))
    return df.select("r", "c", V.class_or_uncertain(p, ["WATER", "CROP", "BARE"], 0.4503).alias("cls"))
