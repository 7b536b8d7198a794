"""Queries of sources, sinks, scalar functions and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as V
from gridloom.operators.grid import point_in_polygon
from gridloom.operators.ordering import ranked_globally
from gridloom.plans.cells import rounded
from gridloom.plans.registry import query, table
from gridloom.sources import readers as R
from gridloom.sources import sinks as K
from gridloom.staging import shared_dir
from gridloom.streaming import windows as T


@query("product_names", "WITH p AS (SELECT o_orderkey AS id, 'S2A_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || 'T084601_N0' || (500 + o_custkey % 10)::VARCHAR || '_R107_T36TXT_' || strftime(o_orderdate, '%Y%m%d') || 'T120000.SAFE' AS name FROM orders) SELECT id, strptime(regexp_extract(name, '_(\\d{8})T', 1), '%Y%m%d')::DATE AS day, regexp_extract(name, '_N(\\d{4})_', 1)::INT AS baseline, regexp_extract(name, '_(T\\w{5})_', 1) AS tile FROM p")
def product_names(spark, sf):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(F.lit("S2A_MSIL2A_"), d, F.lit("T084601_N0"), (500 + F.col("o_custkey") % 10).cast("string"), F.lit("_R107_T36TXT_"), d, F.lit("T120000.SAFE"))
    f = R.product_names(name)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), f["day"], f["baseline"], f["tile"]).toDF("id", "day", "baseline", "tile")


@query("merged_catalogue", "WITH a AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS n_products, coalesce(b.n, 0) AS n_stacks, CASE WHEN a.n > 0 THEN 'product' ELSE 'stack' END AS lineage FROM a FULL JOIN b ON a.day = b.day")
def merged_catalogue(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("day"))
    return R.catalogue(a, table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.to_date("l_shipdate").alias("day")))


@query("packed_mask_round_trip", "SELECT r::INT AS r, c::INT AS c, dem < 24.5 AS value FROM cells", on="cells")
def packed_mask_round_trip(df):
    bits = K.packed_bits(df.withColumn("k", F.lit(1)), ["k"], F.col("dem") < 24.5, 40)
    return R.packed_masks(bits, "bits", ["k"], 40).select("r", "c", "value").join(df.select(F.col("r").cast("int"), F.col("c").cast("int")), ["r", "c"], "left_semi")


@query("index_store_round_trip", "SELECT scene, line, round(round_even(b08 * 10000, 0) / 10000, 4) AS b08 FROM stack WHERE r BETWEEN 10 AND 19", on="stack")
def index_store_round_trip(df):
    """Scaled storage by tile, published after it was read back, read again by row window."""
    path = f"{shared_dir(df.sparkSession)}/bands"
    K.publish(K.scaled(df.select("scene", "line", "r", "c", "b08"), ["b08"]), path)
    stored = df.sparkSession.read.parquet(path).filter("r BETWEEN 10 AND 19")
    return rounded(stored.select("scene", "line", (F.col("b08") / 10000).alias("b08")), "b08", digits=4)


@query("csv_round_trip", "SELECT node, x, y, river FROM nodes", on="nodes")
def csv_round_trip(df):
    path = f"{shared_dir(df.sparkSession)}/csv"
    K.draws_csv(df.select("node", "x", "y", "river"), path, 1)
    return R.csv_table(df.sparkSession, path, "node long, x double, y double, river string")


@query("rasterized_polygon", "SELECT r, c FROM cells WHERE c + 0.5 > 5 AND c + 0.5 < 25 AND r + 0.5 > 5 AND r + 0.5 < 5 + (25 - (c + 0.5))", on="cells")
def rasterized_polygon(df):
    inside = point_in_polygon(F.col("c") + 0.5, F.col("r") + 0.5, [(5.0, 5.0), (25.0, 5.0), (5.0, 25.0)])
    return df.filter(inside).select("r", "c")


@query("scene_metadata", "SELECT p_partkey AS id, 10000.0::DOUBLE AS quantification, (-1000 - p_size)::DOUBLE AS offset_4 FROM part")
def scene_metadata(spark, sf):
    xml = F.concat(F.lit('<a><BOA_QUANTIFICATION_VALUE unit="none">10000</BOA_QUANTIFICATION_VALUE><BOA_ADD_OFFSET band_id="3">-1</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id="4">'), (-1000 - F.col("p_size")).cast("string"), F.lit("</BOA_ADD_OFFSET></a>"))
    m = R.scene_metadata(xml)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m["quantification"].alias("quantification"), F.element_at(m["offsets"], "4").alias("offset_4"))


@query("scalar_families", "SELECT event_id, (json_extract_string(props, '$.k'))::DOUBLE AS k, round_even(value, 0) AS rounded, bit_count(user_id)::INT AS bits, (value > 10)::INT + (value > 20)::INT AS place, split_part(strftime(ts, '%Y-%m-%d'), '-', 2) AS month FROM events")
def scalar_families(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", V.json_number(F.col("props"), "$.k").alias("k"), V.half_even(F.col("value")).alias("rounded"), V.set_bits(F.col("user_id")).alias("bits"), V.searchsorted([10.0, 20.0], F.col("value")).alias("place"), V.part(F.date_format("ts", "yyyy-MM-dd"), "-", 1).alias("month"))


@query("daily_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY ALL")
def daily_windows(spark, sf):
    return rounded(T.daily_summary(table(spark, sf, "events")), "mean")


@query("product_inventory", "SELECT river AS family, count(DISTINCT node) AS n_units, count(*) AS n_files, count(DISTINCT day) AS n_days, min(day) AS first, max(day) AS last FROM obs GROUP BY river", on="obs")
def product_inventory(df):
    return df.groupBy(F.col("river").alias("family")).agg(F.count_distinct("node").alias("n_units"), F.count("*").alias("n_files"), F.count_distinct("day").alias("n_days"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("candidate_ranking", "SELECT node, round(n * 0.7 + x / 5000 * 0.3, 6) AS score, row_number() OVER (ORDER BY round(n * 0.7 + x / 5000 * 0.3, 6) DESC, node) AS rank FROM nodes WHERE n * 0.7 + x / 5000 * 0.3 > 10", on="nodes")
def candidate_ranking(df):
    s = F.round(F.col("n") * 0.7 + F.col("x") / 5000 * 0.3, 6)
    x = df.select("node", s.alias("score")).filter("score > 10")
    return ranked_globally(x, [F.col("score").desc(), F.col("node")])


