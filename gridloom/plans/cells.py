"""Queries of per-cell algebra, decision lists, composites and robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import composites as K
from gridloom.operators import decisions as D
from gridloom.operators import indices as I
from gridloom.plans.registry import query

_VALID = "(scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND b03 > 0)"
_ND = lambda a, b: f"({a} - {b}) / nullif({a} + {b}, 0)"
_INDEX_SQL = {
    "ndvi": _ND("b08", "b04"), "ndwi": _ND("b03", "b08"), "mndwi": _ND("b03", "b11"), "ndmi": _ND("b08", "b11"),
    "bsi": "((b11 + b04) - (b08 + b02)) / nullif((b11 + b04) + (b08 + b02), 0)", "aweish": "b02 + 2.5 * b03 - 1.5 * (b08 + b11) - 0.25 * b12", "ndti": _ND("b04", "b03"),
}
_IND = "i AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _INDEX_SQL.items()) + f", {_VALID} AS valid FROM stack)"
_WATER = "(((coalesce(ndwi, -9) > 0 AND coalesce(mndwi, -9) > 0) OR (scl = 6 AND coalesce(ndwi, -9) > -0.15)) AND scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND valid)"


def indexed(df: DataFrame) -> DataFrame:
    df = df.withColumns(I.spectral_indices()).withColumn("valid", I.is_valid(F.col("scl"), F.col("b03")))
    return df.withColumn("water", I.water_rule(F.col("ndwi"), F.col("mndwi"), F.col("scl"), F.col("valid")))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' orders of summation agree."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


_COMP = ["ndvi", "ndwi", "ndmi"]
_ALL = [*_COMP, "ndbi"]
_COMP_COLS = [f"n_obs_{w}" for w in ("pre", "event", "trace")]
_COMP_VALUES = [f"{i}_{w}_{s}" for i in _ALL for w, ss in (("pre", ("med", "min", "max")), ("event", ("med", "min", "max")), ("trace", ("med",))) for s in ss] + [f"{i}_{d}" for i in _ALL for d in ("d_med", "d_ext", "d_trace")]


def _composite_sql() -> str:
    a = [f"count(*) FILTER (win = '{w}' AND valid) AS n_obs_{w}" for w in ("pre", "event", "trace")]
    for i in _COMP:
        for w in ("pre", "event", "trace"):
            a.append(f"median({i}) FILTER (win = '{w}' AND valid) AS {i}_{w}_med")
            if w != "trace":
                a += [f"{f}({i}) FILTER (win = '{w}' AND valid) AS {i}_{w}_{f}" for f in ("min", "max")]
    n = [f"-ndmi_{w}_med AS ndbi_{w}_med" for w in ("pre", "event", "trace")] + [f"-ndmi_{w}_{f} AS ndbi_{w}_{g}" for w in ("pre", "event") for f, g in (("max", "min"), ("min", "max"))]
    d = []
    for i in _ALL:
        hi, lo = f"({i}_event_max - {i}_pre_med)", f"({i}_event_min - {i}_pre_med)"
        d += [f"{i}_event_med - {i}_pre_med AS {i}_d_med", f"CASE WHEN abs(coalesce({hi}, 0)) >= abs(coalesce({lo}, 0)) THEN {hi} ELSE {lo} END AS {i}_d_ext", f"{i}_trace_med - {i}_pre_med AS {i}_d_trace"]
    values = ", ".join(f"round({v}, 6) AS {v}" for v in _COMP_VALUES)
    return f"WITH {_IND}, a AS (SELECT r, c, {', '.join(a)} FROM i GROUP BY r, c), b AS (SELECT *, {', '.join(n)} FROM a), d AS (SELECT *, {', '.join(d)} FROM b) SELECT r, c, {', '.join(_COMP_COLS)}, {values} FROM d"


@query("composite_windows", _composite_sql(), on="stack")
def composite_windows(df):
    """The PRE/EVENT/TRACE composite: validity, indices, conditional medians and extremes, changes."""
    return rounded(K.window_composite(indexed(df), _COMP), *_COMP_VALUES)


@query("spectral_indices", f"WITH {_IND} SELECT scene, line, r, c, valid, " + ", ".join(f"round({k}, 10) AS {k}" for k in _INDEX_SQL) + " FROM i", on="stack")
def spectral_indices(df):
    return rounded(indexed(df), *_INDEX_SQL, digits=10).select("scene", "line", "r", "c", "valid", *_INDEX_SQL)


@query("moisture_indices", "SELECT scene, line, round(b11 / nullif(b08, 0), 6) AS msi, round((b08 - b11) / nullif(b08 + b11, 0), 6) AS ndmi11, round((b08 - b12) / nullif(b08 + b12, 0), 6) AS ndmi12, round(b11 / nullif(b12, 0), 6) AS swir_ratio FROM stack", on="stack")
def moisture(df):
    m = I.moisture_indices()
    return rounded(df.withColumns(m), *m).select("scene", "line", *m)


@query("reflectance_offsets", "SELECT scene, line, round((b08 * 10000 + CASE WHEN scl = 4 THEN -1000 ELSE 0 END) / 10000, 10) AS boa FROM stack", on="stack")
def reflectance_offsets(df):
    offset = F.element_at(F.create_map(F.lit(4), F.lit(-1000.0)), F.col("scl"))
    return rounded(df.select("scene", "line", I.reflectance(F.col("b08") * 10000, offset).alias("boa")), "boa", digits=10)


@query("water_mask", f"WITH {_IND} SELECT scene, line, {_WATER} AS water, CASE WHEN valid THEN {_WATER} END AS water3 FROM i", on="stack")
def water_mask(df):
    return indexed(df).select("scene", "line", "water", I.three_valued(F.col("water"), F.col("valid")).alias("water3"))


_SURF = """CASE WHEN NOT valid THEN 0
 WHEN NOT w AND v >= 0.30 AND m >= 0.10 THEN 7 WHEN NOT w AND v >= 0.30 AND m < 0.10 THEN 6 WHEN NOT w AND v >= 0.15 AND v < 0.30 AND m < 0.10 THEN 5
 WHEN NOT w AND m >= 0.10 AND v < 0.30 AND b < 0.10 THEN 3 WHEN NOT w AND (scl = 5 OR b >= 0.10) AND v < 0.15 AND m < 0.10 THEN 4 WHEN w AND line = 1 THEN 2 WHEN w THEN 1 WHEN line = 1 AND w THEN 2 ELSE 9 END"""


@query("surface_classes", f"WITH {_IND}, s AS (SELECT *, {_WATER} AS w, coalesce(ndvi, -9) AS v, coalesce(ndmi, -9) AS m, coalesce(bsi, -9) AS b FROM i) SELECT scene, line, {_SURF} AS cls FROM s", on="stack")
def surface_classes(df):
    x = indexed(df)
    edge = (F.col("line") == 1) & F.col("water")
    return x.select("scene", "line", D.surface_class(F.col("ndvi"), F.col("ndmi"), F.col("bsi"), F.col("scl"), F.col("water"), edge, F.col("valid")).alias("cls"))


@query("three_valued_areas", f"WITH {_IND}, t AS (SELECT win, CASE WHEN valid THEN {_WATER} END AS w FROM i) SELECT win, count(*) FILTER (w) AS n_water, count(*) FILTER (NOT w) AS n_dry, count(*) FILTER (w IS NULL) AS n_unseen FROM t GROUP BY win", on="stack")
def three_valued_areas(df):
    x = indexed(df).withColumn("w", I.three_valued(F.col("water"), F.col("valid")))
    return x.groupBy("win").agg(F.count_if("w").alias("n_water"), F.count_if(~F.col("w")).alias("n_dry"), F.count_if(F.col("w").isNull()).alias("n_unseen"))


@query("scaled_storage", f"WITH {_IND} SELECT scene, line, CASE WHEN valid AND ndvi IS NOT NULL THEN greatest(least(round_even(ndvi * 10000, 0), 32767), -32767)::INT END AS ndvi_i16, CASE WHEN aweish IS NOT NULL THEN greatest(least(round_even(aweish * 10000, 0), 32767), -32767)::INT END AS awei_i16 FROM i", on="stack")
def scaled_storage(df):
    x = indexed(df)
    return x.select("scene", "line", I.to_scaled(F.col("ndvi"), F.col("valid")).alias("ndvi_i16"), I.to_scaled(F.col("aweish")).alias("awei_i16"))


@query("true_colour_bytes", f"SELECT scene, line, CASE WHEN {_VALID} THEN round_even(least(greatest(b04 / 0.3, 0), 1) * 255, 0)::INT ELSE 0 END AS red, CASE WHEN {_VALID} THEN round_even(pow(least(greatest(b03 / 0.3, 0), 1), 0.5) * 255, 0)::INT ELSE 0 END AS green FROM stack", on="stack")
def true_colour(df):
    valid = I.is_valid(F.col("scl"), F.col("b03"))
    return df.select("scene", "line", I.stretch_to_byte(F.col("b04"), valid).alias("red"), I.stretch_to_byte(F.col("b03"), valid, gamma=0.5).alias("green"))


@query("radar_decibels", "SELECT scene, orbit, r, c, round(CASE WHEN vv > 0 THEN 10 * log10(vv) END, 6) AS vv_db, round(10 * log10(vh), 6) AS vh_db FROM sar", on="sar")
def radar_decibels(df):
    return rounded(df.select("scene", "orbit", "r", "c", I.to_decibel(F.col("vv")).alias("vv_db"), I.to_decibel(F.col("vh")).alias("vh_db")), "vv_db", "vh_db")


_BASE_SQL = f"WITH {_IND}, a AS (SELECT r, c, count(*) FILTER (valid) AS n, median(ndvi) FILTER (valid) AS ndvi, median(ndwi) FILTER (valid) AS ndwi, median(mndwi) FILTER (valid) AS mndwi, median(ndmi) FILTER (valid) AS ndmi, median(bsi) FILTER (valid) AS bsi, 100 * avg(CASE WHEN valid THEN {_WATER}::INT END) AS wf FROM i WHERE win = 'pre' GROUP BY r, c), b AS (SELECT a.*, cells.wc * 10 AS cover FROM a JOIN cells USING (r, c))"
_BASE_CASE = "CASE WHEN n = 0 OR ndvi IS NULL OR ndwi IS NULL OR mndwi IS NULL THEN NULL WHEN n < 3 THEN 6 WHEN wf >= 20 OR (ndwi > 0 AND mndwi > 0) THEN 0 WHEN cover = 60 OR (bsi >= 0.1 AND ndvi < 0.15 AND ndmi < 0.1) THEN 2 WHEN cover = 90 THEN 4 WHEN cover = 50 THEN 3 WHEN ndvi >= 0.15 OR cover IN (10, 20, 30, 40, 95, 100) THEN 1 ELSE 5 END"


def base_of(spark, sf):
    from gridloom.plans.registry import fixture

    x = indexed(fixture(spark, sf, "stack")).filter("win = 'pre'")
    seen = lambda k: F.median(F.when(F.col("valid"), F.col(k))).alias(k)
    a = x.groupBy("r", "c").agg(F.count_if("valid").alias("n"), *(seen(k) for k in ("ndvi", "ndwi", "mndwi", "ndmi", "bsi")), (100 * F.avg(F.when(F.col("valid"), F.col("water").cast("int")))).alias("wf"))
    a = a.join(fixture(spark, sf, "cells").select("r", "c", "wc", "score"), ["r", "c"])
    cls = D.base_class(*(F.col(k) for k in ("ndvi", "ndwi", "mndwi", "ndmi", "bsi", "n", "wf")), F.col("wc") * 10)
    return a.withColumn("base", cls)


@query("base_class", f"{_BASE_SQL} SELECT r, c, {_BASE_CASE} AS base FROM b")
def base_class(spark, sf):
    return base_of(spark, sf).select("r", "c", "base")


_STATE_SQL = f"{_BASE_SQL}, s AS (SELECT b.r, b.c, {_BASE_CASE} AS base, cells.score >= 0.4603 AS core, cells.score >= 0.4203 AS central, cells.score >= 0.3803 AS possible, cells.cn > 30 AS valid FROM b JOIN (SELECT r, c, score, n AS cn FROM cells) AS cells USING (r, c))"
_STAB = "CASE WHEN NOT valid THEN NULL WHEN core THEN 1 WHEN central THEN 2 WHEN possible THEN 3 ELSE 4 END"
_SEM = "CASE WHEN NOT valid OR base IS NULL THEN NULL WHEN base = 0 THEN 0 WHEN base = 6 THEN 7 WHEN central THEN CASE base WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 WHEN 5 THEN 5 END ELSE 6 END"


def states_of(spark, sf):
    from gridloom.plans.registry import fixture

    x = base_of(spark, sf).select("r", "c", "base").join(fixture(spark, sf, "cells"), ["r", "c"])
    s = F.col("score")
    valid = F.col("n") > 30
    return x.withColumns({"stability": D.decision_stability(s >= 0.4603, s >= 0.4203, s >= 0.3803, valid), "semantic": D.semantic_state(F.col("base"), s >= 0.4203, valid)})


@query("decision_states", f"{_STATE_SQL} SELECT r, c, {_STAB} AS stability, {_SEM} AS semantic FROM s")
def decision_states(spark, sf):
    return states_of(spark, sf).select("r", "c", "stability", "semantic")


@query("state_crosstab", f"{_STATE_SQL} SELECT {_SEM} AS semantic, {_STAB} AS stability, count(*) AS n, round(count(*) * 1e-4, 6) AS km2 FROM s GROUP BY ALL")
def state_crosstab(spark, sf):
    return states_of(spark, sf).groupBy("semantic", "stability").agg(F.count("*").alias("n"), F.round(F.count("*") * 1e-4, 6).alias("km2"))


@query("threshold_classes", "SELECT id, CASE WHEN s >= 0.7 THEN 'core' WHEN s >= 0.5 THEN 'central' WHEN s >= 0.3 THEN 'possible' ELSE 'none' END AS cls FROM scored", on="scored")
def threshold_classes(df):
    return df.select("id", D.threshold_class(F.col("s"), 0.3, 0.5, 0.7).alias("cls"))


_SEEN = f"WITH {_IND}, a AS (SELECT r, c, count(*) FILTER (win = 'pre' AND valid) AS po, count(*) FILTER (win = 'pre' AND valid AND {_WATER}) AS pw, count(*) FILTER (win = 'event' AND valid AND {_WATER}) AS ew, count(*) FILTER (win = 'trace' AND valid AND {_WATER}) AS tw, count(*) FILTER (win = 'trace' AND valid) AS t_, CASE WHEN count(*) % 5 > 0 THEN 100 * avg(CASE WHEN valid THEN {_WATER}::INT END) END AS wf FROM i GROUP BY r, c)"
_WEAK = "CASE WHEN po + t_ = 0 THEN NULL WHEN po >= 1 AND pw = 0 AND coalesce(wf, 100) < 20 AND ew >= 1 THEN 1 WHEN po >= 1 AND pw = 0 AND coalesce(wf, 100) < 20 AND tw = 0 AND t_ >= 2 THEN 0 ELSE 2 END"


def seen_counts(df):
    x = indexed(df)
    n = lambda w, what: F.count_if((F.col("win") == w) & what)
    v, wet = F.col("valid"), F.col("valid") & F.col("water")
    return x.groupBy("r", "c").agg(n("pre", v).alias("po"), n("pre", wet).alias("pw"), n("event", wet).alias("ew"), n("trace", wet).alias("tw"), n("trace", v).alias("t_"), F.when(F.count("*") % 5 > 0, 100 * F.avg(F.when(v, F.col("water").cast("int")))).alias("wf"))


@query("weak_labels", f"{_SEEN} SELECT r, c, {_WEAK} AS label FROM a", on="stack")
def weak_labels(df):
    return seen_counts(df).select("r", "c", D.weak_label(F.col("po"), F.col("pw"), F.col("wf"), F.col("ew"), F.col("tw"), F.col("t_"), need_peak=1).alias("label"))


_LABEL_GATES = {"unobserved_negatives": 0.0, "no_positive": 0.0, "coverage": None, "prevalence": None, "confirmed_positives": None, "window_overlap": None, "most_positives_of_a_class": None, "coarse_difference": 0.02, "missing_tags": 0.0}
_LABEL_TAGS = ("rule", "values", "kind", "cell", "peaks")


@query("label_gates", f"""{_SEEN}, l AS (SELECT *, {_WEAK} AS y FROM a), k AS (SELECT count(*) FILTER (y = 1) AS n FROM l GROUP BY c % 7),
m AS (SELECT count(*) FILTER (po + t_ = 0 AND y = 0)::DOUBLE AS unobserved_negatives, (count(*) FILTER (y = 1) = 0)::INT::DOUBLE AS no_positive, 100 * avg((po >= 1)::INT) AS coverage,
count(*) FILTER (y = 1)::DOUBLE / greatest(count(*) FILTER (y IN (0, 1)), 1) AS prevalence, 100 * count(*) FILTER (y = 1 AND tw > 0) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS confirmed_positives,
count(*) FILTER (pw > 0 AND ew > 0) / nullif(count(*) FILTER (pw > 0 OR ew > 0), 0)::DOUBLE AS window_overlap, (SELECT max(n) FROM k)::DOUBLE AS most_positives_of_a_class,
greatest(abs(4 * count(*) FILTER (y = 1 AND r % 2 = 0 AND c % 2 = 0) - count(*) FILTER (y = 1)) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, abs(4 * count(*) FILTER (y = 0 AND r % 2 = 0 AND c % 2 = 0) - count(*) FILTER (y = 0)) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE) AS coarse_difference, 1::DOUBLE AS missing_tags FROM l),
u AS (SELECT * FROM m UNPIVOT INCLUDE NULLS (measured FOR gate IN (COLUMNS(*))))
SELECT gate, round(measured, 6) AS measured, CASE gate WHEN 'coarse_difference' THEN 0.02::DOUBLE WHEN 'unobserved_negatives' THEN 0 WHEN 'no_positive' THEN 0 WHEN 'missing_tags' THEN 0 END AS most,
CASE WHEN measured IS NULL THEN 'INCOMPLETE' WHEN gate IN ('unobserved_negatives', 'no_positive', 'missing_tags') THEN CASE WHEN measured <= 0 THEN 'PASS' ELSE 'FAIL' END WHEN gate = 'coarse_difference' THEN CASE WHEN measured <= 0.02 THEN 'PASS' ELSE 'FAIL' END ELSE 'REPORTED' END AS status FROM u""", on="stack")
def label_gates(df):
    """Gates of the weak labels; the tags at hand lack one of those that are required. Components have queries of their own."""
    from gridloom.operators.gates import bounded_gates

    a = seen_counts(df)
    y = D.weak_label(F.col("po"), F.col("pw"), F.col("wf"), F.col("ew"), F.col("tw"), F.col("t_"), need_peak=1)
    one, none, even = F.col("y") == 1, F.col("y") == 0, (F.col("r") % 2 == 0) & (F.col("c") % 2 == 0)
    parts = {
        "bad": (F.col("po") + F.col("t_") == 0) & none, "pos": one, "neg": none, "seen": F.col("po") >= 1, "sure": one & (F.col("tw") > 0), "both": (F.col("pw") > 0) & (F.col("ew") > 0), "any": (F.col("pw") > 0) | (F.col("ew") > 0),
        "pos4": one & even, "neg4": none & even,
    }
    by_class = a.withColumn("y", y).groupBy(F.col("c") % 7).agg(F.count("*").alias("n"), *(F.count_if(v).alias(k) for k, v in parts.items()))
    t = by_class.agg(F.max("pos").alias("top"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in parts))
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of))
    off = lambda k: F.when(F.col(k) > 0, F.abs(4 * F.col(f"{k}4") - F.col(k)) / F.col(k))
    have = ("rule", "values", "kind", "cell")
    m = t.select(
        F.col("bad").alias("unobserved_negatives"), (F.col("pos") == 0).cast("int").alias("no_positive"), (100 * share("seen", "n")).alias("coverage"), (F.col("pos") / F.greatest(F.col("pos") + F.col("neg"), F.lit(1))).alias("prevalence"),
        (100 * share("sure", "pos")).alias("confirmed_positives"), share("both", "any").alias("window_overlap"), F.col("top").alias("most_positives_of_a_class"), F.greatest(off("pos"), off("neg")).alias("coarse_difference"), F.lit(len(set(_LABEL_TAGS) - set(have))).alias("missing_tags"),
    )
    return rounded(bounded_gates(m, _LABEL_GATES), "measured")


_EVIDENCE = "CASE WHEN t >= 0.03 AND q > 25 THEN 'S2_WATER' WHEN t >= 0.03 AND r % 3 > 0 THEN 'S2_DRY' WHEN d < 0.06 THEN CASE WHEN q > 35 AND q / 50 > 0.3 THEN 'S1_WATER' WHEN q <= 35 AND c % 2 = 0 THEN 'S1_DRY' ELSE 'BLIND' END WHEN t >= 0.03 THEN 'BLIND' ELSE 'NONE' END"


@query("day_states", f"WITH e AS (SELECT *, {_EVIDENCE} AS evidence, q / 50 AS p, (r + c) % 11 = 0 AS ref, d = 0.07 AS rec FROM cell_day), s AS (SELECT *, evidence LIKE '%WATER' OR evidence LIKE '%DRY' AS seen, p >= 0.8 OR (p <= 0.05 AND NOT (rec AND NOT ref)) AS sure FROM e) SELECT r, c, day, evidence, CASE WHEN seen THEN substr(evidence, 4) WHEN ref OR p >= 0.8 THEN 'WATER' WHEN sure THEN 'DRY' ELSE 'UNKNOWN' END AS state, CASE WHEN seen THEN 'EO_' || substr(evidence, 1, 2) WHEN ref THEN 'REFERENCE' WHEN sure AND c % 5 = 0 THEN 'MODEL_WEAK' WHEN sure THEN 'MODEL_STRONG' ELSE 'NONE' END AS source FROM s", on="cell_day")
def day_states(df):
    q = F.col("q")
    evidence = D.day_evidence(F.col("t") >= 0.03, q > 25, F.col("r") % 3 == 0, F.col("d") < 0.06, q > 35, q / 50 > 0.3, F.col("c") % 2 == 0)
    state = D.day_state(F.col("evidence"), q / 50, (F.col("r") + F.col("c")) % 11 == 0, F.col("d") == 0.07, F.col("c") % 5 == 0)
    return df.select("r", "c", "day", "q", "d", evidence.alias("evidence")).withColumn("_s", state).select("r", "c", "day", "evidence", "_s.*")


@query("combined_labels", f"{_SEEN}, l AS (SELECT *, {_WEAK} AS lab, CASE WHEN t_ % 4 = 3 THEN NULL ELSE t_ % 3 END AS m, ew > 0 AS rw FROM a) SELECT r, c, CASE WHEN rw AND m IS NOT NULL AND m <> 2 THEN NULL WHEN lab = 1 AND rw AND m = 2 THEN 1 WHEN lab = 0 AND coalesce(m <> 1, true) AND coalesce(m <> 2, true) THEN 0 END AS y FROM l", on="stack")
def combined_labels(df):
    a = seen_counts(df)
    lab = D.weak_label(F.col("po"), F.col("pw"), F.col("wf"), F.col("ew"), F.col("tw"), F.col("t_"), need_peak=1)
    model = F.when(F.col("t_") % 4 != 3, F.col("t_") % 3)
    return a.select("r", "c", D.combined_label(lab, F.col("ew") > 0, model).alias("y"))


@query("label_ontology", "WITH x AS (SELECT r, c, wc % 3 AS dom, ground + wc AS nv, wc AS nw, n % 2 AS y2, ground % 3 AS np, score > 0.4003 AS cen FROM cells), y AS (SELECT *, CASE WHEN dom = 2 THEN 4 WHEN dom = 1 AND nv < 3 THEN 3 WHEN dom = 1 AND nw <= 1 THEN 2 WHEN dom = 1 AND nw / greatest(nv, 1) >= 0.5 THEN 1 WHEN dom = 1 THEN 6 ELSE 5 END AS reason FROM x), z AS (SELECT *, CASE reason WHEN 1 THEN 2 WHEN 2 THEN 0 END AS ref FROM y), w AS (SELECT *, CASE WHEN np >= 2 AND (cen OR coalesce(ref = 2, false)) THEN 1 WHEN y2 = 0 THEN 0 END AS event_wet FROM z) SELECT r, c, reason, ref, event_wet, CASE WHEN event_wet = 1 AND y2 = 1 THEN 1 WHEN ref = 2 THEN 2 WHEN event_wet = 0 AND ref = 0 THEN 0 END AS ontology FROM w", on="cells")
def label_ontology(df):
    x = df.select("r", "c", (F.col("wc") % 3).alias("dom"), (F.col("ground") + F.col("wc")).alias("nv"), F.col("wc").alias("nw"), (F.col("n") % 2).alias("y2"), (F.col("ground") % 3).alias("np"), (F.col("score") > 0.4003).alias("cen"))
    x = x.withColumn("reason", D.reference_reason(F.col("dom"), F.col("nv"), F.col("nw")))
    x = x.withColumn("ref", F.when(F.col("reason") == 1, 2).when(F.col("reason") == 2, 0))
    null = F.lit(None).cast("int")
    x = x.withColumn("event_wet", D.last_wins([(F.col("y2") == 0, 0), ((F.col("np") >= 2) & (F.col("cen") | D.true(F.col("ref") == 2)), 1)], null))
    flood = D.true(F.col("event_wet") == 1) & (F.col("y2") == 1)
    ont = D.last_wins([(D.true(F.col("event_wet") == 0) & D.true(F.col("ref") == 0), 0), (D.true(F.col("ref") == 2) & ~flood, 2), (flood, 1)], null)
    return x.select("r", "c", "reason", "ref", "event_wet", ont.alias("ontology"))


_FL = {1: "LOW", 2: "HIGH_SCORE", 4: "SPARSE", 8: "CLASS_ZERO"}


@query("bit_flags", "WITH f AS (SELECT r, c, wc, (dem < 24)::INT + 2 * (score > 0.4003)::INT + 4 * (n < 30)::INT + 8 * (wc = 0)::INT AS flags FROM cells) SELECT r, c, flags, array_to_string(list_filter([CASE WHEN flags & 1 > 0 THEN 'LOW' END, CASE WHEN flags & 2 > 0 THEN 'HIGH_SCORE' END, CASE WHEN flags & 4 > 0 THEN 'SPARSE' END, CASE WHEN flags & 8 > 0 THEN 'CLASS_ZERO' END], lambda x: x IS NOT NULL), '|') AS names FROM f", on="cells")
def bit_flags(df):
    x = df.withColumn("flags", D.flags({1: F.col("dem") < 24, 2: F.col("score") > 0.4003, 4: F.col("n") < 30, 8: F.col("wc") == 0}))
    return x.select("r", "c", "flags", F.array_join(D.flag_names(F.col("flags"), _FL), "|").alias("names"))


@query("bit_or_by_class", "SELECT wc, bit_or((dem < 24)::INT + 2 * (score > 0.4003)::INT) AS flags FROM cells GROUP BY wc", on="cells")
def bit_or_by_class(df):
    return df.groupBy("wc").agg(F.bit_or(D.flags({1: F.col("dem") < 24, 2: F.col("score") > 0.4003})).alias("flags"))


@query("radar_evidence", "SELECT id, CASE WHEN id % 5 = 0 OR s < 0.3 THEN 'S1_UNOBSERVED' ELSE CASE WHEN block % 3 = 0 THEN '' ELSE 'LATER_' END || CASE WHEN block / 40 >= 0.5 THEN 'S1_WATER' WHEN y = 1 AND block / 40 <= 0.1 THEN 'S1_OPEN_SURFACE_NO_WATER' WHEN s >= 0.5 AND block / 40 <= 0.1 THEN 'S1_NO_WATER_SIGNAL_VEGETATED' ELSE 'S1_INCONCLUSIVE' END END AS flag FROM scored", on="scored")
def radar_evidence(df):
    lag = F.when(F.col("id") % 5 != 0, F.col("block") % 3)
    dark = F.col("block") / 40
    return df.select("id", D.radar_flag(lag, F.col("s"), dark, F.col("y"), F.lit(1.0), dark).alias("flag"))


@query("index_display_class", f"WITH {_IND} SELECT scene, line, CASE WHEN ndvi IS NULL THEN NULL WHEN ndvi >= 0.6 THEN 4 WHEN ndvi >= 0.3 THEN 3 WHEN ndvi >= 0.0 THEN 2 WHEN ndvi >= -0.3 THEN 1 ELSE 0 END AS cls, CASE WHEN ndvi > -1 AND ndvi <= 0 THEN 'low' WHEN ndvi > 0 AND ndvi <= 0.5 THEN 'mid' WHEN ndvi > 0.5 AND ndvi <= 1 THEN 'high' END AS band FROM i", on="stack")
def index_display_class(df):
    x = indexed(df)
    return x.select("scene", "line", D.digitize(F.col("ndvi"), [-0.3, 0.0, 0.3, 0.6]).alias("cls"), D.cut(F.col("ndvi"), [-1, 0, 0.5, 1], ["low", "mid", "high"]).alias("band"))


@query("season_terms", "SELECT scene, line, month(day) BETWEEN 5 AND 8 AS in_season, dayofyear(day) AS doy, round(sin(2 * pi() * dayofyear(day) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(day) / 365.25), 6) AS doy_cos FROM stack", on="stack")
def season_terms(df):
    d = F.dayofyear("day")
    return df.select("scene", "line", F.month("day").between(5, 8).alias("in_season"), d.alias("doy"), F.round(F.sin(2 * F.pi() * d / 365.25), 6).alias("doy_sin"), F.round(F.cos(2 * F.pi() * d / 365.25), 6).alias("doy_cos"))


@query("class_mode", "WITH k AS (SELECT r, c, scl, count(*) AS n FROM stack WHERE scl <> 8 GROUP BY ALL) SELECT r, c, arg_min(scl, (-n, scl)) AS mode, sum(n)::BIGINT AS n FROM k GROUP BY r, c", on="stack")
def class_mode(df):
    return K.class_mode(df.withColumn("scl", F.when(F.col("scl") != 8, F.col("scl"))).filter("scl IS NOT NULL"), "scl")


@query("water_share", f"WITH {_IND} SELECT r, c, count(*) FILTER (valid) AS n, round_even(100 * avg(CASE WHEN valid THEN {_WATER}::INT END), 0)::INT AS share FROM i GROUP BY r, c", on="stack")
def water_share(df):
    x = indexed(df)
    return x.groupBy("r", "c").agg(F.count_if("valid").alias("n"), K.percent(F.when(F.col("valid"), F.col("water"))).alias("share"))


@query("scl_shares", "WITH o AS (SELECT r, c, count(*) AS n, round_even(100 * avg((scl = 4)::INT), 0)::INT AS share_veg, round_even(100 * avg((scl = 6)::INT), 0)::INT AS share_water, round_even(100 * avg((scl IN (3, 8, 9, 10, 11))::INT), 0)::INT AS share_cloud FROM stack GROUP BY r, c), k AS (SELECT r, c, scl, count(*) AS n FROM stack GROUP BY ALL), m AS (SELECT r, c, arg_min(scl, (-n, scl)) AS mode FROM k GROUP BY r, c) SELECT * FROM o JOIN m USING (r, c)", on="stack")
def scl_shares(df):
    return K.class_shares(df.select("r", "c", "scl"), "scl", {"veg": (4,), "water": (6,), "cloud": (3, 8, 9, 10, 11)})


@query("median_index", f"WITH {_IND} SELECT r, c, round_even(median(ndvi) FILTER (valid) * 10000, 0)::INT AS ndvi_i16, count(ndvi) FILTER (valid) AS n FROM i GROUP BY r, c", on="stack")
def median_index(df):
    x = indexed(df).withColumn("v", F.when(F.col("valid"), F.col("ndvi")))
    return x.groupBy("r", "c").agg(I.to_scaled(F.median("v")).alias("ndvi_i16"), K.n_valid(F.col("v")).alias("n"))


@query("observed_dates", f"WITH {_IND} SELECT r, c, count(DISTINCT day) FILTER (valid) AS n_dates FROM i GROUP BY r, c", on="stack")
def observed_dates(df):
    return K.distinct_date_count(indexed(df), "day", F.col("valid"))


@query("distinct_orbits", "SELECT r, c, count(DISTINCT orbit) FILTER (vv > 0) AS n_orbits FROM sar GROUP BY r, c", on="sar")
def distinct_orbits(df):
    return df.groupBy("r", "c").agg(F.count_distinct(F.when(I.to_decibel(F.col("vv")).isNotNull(), F.col("orbit"))).alias("n_orbits"))


_DB = "d AS (SELECT *, CASE WHEN vv > 0 THEN 10 * log10(vv) END AS db, 10 * log10(vh) AS hb FROM sar)"
_ORB = f"{_DB}, m AS (SELECT r, c, orbit, median(db) AS med, count(db) AS n FROM d WHERE win = 'pre' GROUP BY ALL), b AS (SELECT m.r, m.c, m.orbit, med, n, greatest(median(abs(db - med)), 0.1) AS mad FROM m JOIN d ON d.r = m.r AND d.c = m.c AND d.orbit = m.orbit AND d.win = 'pre' GROUP BY ALL)"


def decibels(df):
    return df.withColumns({"db": I.to_decibel(F.col("vv")), "hb": I.to_decibel(F.col("vh"))})


@query("orbit_baseline", f"WITH {_ORB} SELECT r, c, orbit, round(med, 6) AS med, round(mad, 6) AS mad, n FROM b", on="sar")
def orbit_baseline(df):
    return rounded(K.robust_baseline(decibels(df).filter("win = 'pre'"), "db", ["r", "c", "orbit"]), "med", "mad")


@query("event_anomaly", f"WITH {_ORB}, z AS (SELECT d.r, d.c, d.db - b.med AS dvv, (d.db - b.med) / b.mad AS z FROM d JOIN b USING (r, c, orbit) WHERE d.win = 'event') SELECT r, c, count(dvv) AS n, round(median(dvv), 6) AS d_med, round(min(z), 6) AS z_min FROM z GROUP BY r, c", on="sar")
def event_anomaly(df):
    x = decibels(df)
    base = K.robust_baseline(x.filter("win = 'pre'"), "db", ["r", "c", "orbit"]).drop("n")
    z = x.filter("win = 'event'").join(base, ["r", "c", "orbit"]).withColumns({"dvv": F.col("db") - F.col("med"), "z": (F.col("db") - F.col("med")) / F.col("mad")})
    return rounded(z.groupBy("r", "c").agg(F.count("dvv").alias("n"), F.median("dvv").alias("d_med"), F.min("z").alias("z_min")), "d_med", "z_min")


@query("cross_ratio_anomaly", f"WITH {_DB}, m AS (SELECT r, c, median(db) AS mv, median(hb) AS mh FROM d WHERE win = 'pre' GROUP BY r, c) SELECT d.scene, d.r, d.c, round((db - hb) - (mv - mh), 6) AS d_ratio FROM d JOIN m USING (r, c) WHERE win = 'event'", on="sar")
def cross_ratio(df):
    x = decibels(df)
    m = x.filter("win = 'pre'").groupBy("r", "c").agg(F.median("db").alias("mv"), F.median("hb").alias("mh"))
    return rounded(x.filter("win = 'event'").join(m, ["r", "c"]).select("scene", "r", "c", (F.col("db") - F.col("hb") - (F.col("mv") - F.col("mh"))).alias("d_ratio")), "d_ratio")


@query("nmad_by_river", "WITH m AS (SELECT river, median(h) AS med, count(h) AS n FROM obs GROUP BY river) SELECT river, round(med, 6) AS med, n, round(1.4826 * median(abs(h - med)), 6) AS nmad FROM obs JOIN m USING (river) GROUP BY river, med, n", on="obs")
def nmad_by_river(df):
    return rounded(K.nmad(df, "h", ["river"]), "med", "nmad")


@query("robust_z_nodes", "WITH m AS (SELECT river, median(h) AS med FROM obs GROUP BY river), s AS (SELECT river, med, 1.4826 * median(abs(h - med)) AS sd FROM obs JOIN m USING (river) GROUP BY river, med) SELECT node, day, h, river, round(CASE WHEN sd > 0 THEN (med - h) / sd ELSE 0 END, 6) AS z FROM obs JOIN s USING (river)", on="obs")
def robust_z_nodes(df):
    return rounded(K.robust_z(df, "h", ["river"]), "z").select("node", "day", "h", "river", "z")


@query("leave_one_orbit_out", f"WITH {_DB}, h AS (SELECT DISTINCT r % 8 AS t, orbit AS held FROM d), p AS (SELECT h.t, held, db FROM h JOIN d ON d.r % 8 = h.t AND d.orbit <> held), m AS (SELECT t, held, median(db) AS med, count(db) AS n FROM p GROUP BY ALL) SELECT m.t, m.held, round(med, 6) AS med, n, round(median(abs(db - med)), 6) AS mad FROM m JOIN p USING (t, held) GROUP BY m.t, m.held, med, n", on="sar")
def leave_one_orbit_out(df):
    x = decibels(df).withColumn("t", F.col("r") % 8)
    return rounded(K.leave_one_out(x, "db", ["t"], "orbit"), "med", "mad").select("t", "held", "med", "n", "mad")


_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]


@query("histogram_quantile", "WITH h AS (SELECT ground, least(floor(dem / 10), 4)::INT AS bin, count(*) AS n FROM cells WHERE dem BETWEEN 0 AND 50 GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY ground ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY ground) AS tot FROM h) SELECT ground, round(arg_min(10 * bin + 10 * (0.9 * tot - (cum - n)) / n, bin), 6) AS q FROM k WHERE cum >= 0.9 * tot GROUP BY ground", on="cells")
def histogram_quantile(df):
    return rounded(K.quantile_from_histogram(K.histogram(df, "dem", _EDGES, ["ground"]), _EDGES, 0.9, ["ground"]), "q")
