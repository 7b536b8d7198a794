"""The registered queries of this subpackage and their SQL. Each query is thin: it applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import find_contamination, n_hit
from gridloom.llm.html_text import extract_text
from gridloom.llm.jaccard_join import jaccard_join
from gridloom.llm.language_id import identify, learn
from gridloom.llm.mixing import mix, taken
from gridloom.llm.personal_data import BASE_KINDS, listed, n_of, personal_data
from gridloom.llm.quality_model import score, text_features, train
from gridloom.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from gridloom.llm.schema import held_out
from gridloom.llm.shared import shared_dir
from gridloom.llm.token_files import read_token_files, write_token_files
from gridloom.llm.url_filters import url_filters, url_host, url_keys


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(docs).select("doc_id", *(F.col(f"quality_rules.{k}").alias(k) for k in names))


def _quality_sql(columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept", where: str = "") -> str:
    held = " AND ".join(f"(CASE WHEN {r.bottom} > 0 THEN {r.top}::DOUBLE / {r.bottom} ELSE 0 END) BETWEEN {r.least} AND {r.most}" for r in RULES)
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return f"""
WITH w AS (
  SELECT d.*, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents d
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), s AS (
  SELECT l.* EXCLUDE (t, ws, ls), len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN cov USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), r AS (
  SELECT *, NOT base_failed AND {held} AS kept FROM v
)
SELECT {columns} FROM r {where}"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path())
    return read_token_files(spark, folder)


def _digits(x: Column, at: int) -> Column:
    """A number from 0 to 65535 out of the md5 of a text; DuckDB has the same."""
    return F.conv(F.substring(F.md5(x.cast("binary")), at, 4), 16, 10).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch date: one of the 365 days from 2024-01-01 by the md5 of the URL stands for it."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _digits(F.coalesce("url", F.lit("")), 1) % 365).alias("fetch_day"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of a pages table, by the md5 of each key: a listing, for half of them its end, for a quarter a second one.

    Three of four hosts and host/segment keys have entries; registered domains have a block in spring, hosts under them an exception.
    """
    url = F.col("url")
    host = pages.select(url_host(url).alias("host"), F.element_at(url_keys(url, 1), -1).alias("deep")).filter("host IS NOT NULL").distinct()
    keys = (
        host.select(F.col("host").alias("key"), F.lit("block").alias("list"))
        .union(host.filter("deep <> host AND contains(deep, '/')").select(F.col("deep").alias("key"), F.lit("allow").alias("list")))
        .union(host.select(F.substring_index("host", ".", -2).alias("key"), F.lit("block").alias("list")))
        .distinct()
    )
    turn = _digits(F.col("key"), 5) % 4
    day = lambda at, low, wide: F.date_add(F.lit("2024-01-01").cast("date"), F.lit(low) + _digits(F.col("key"), at) % wide)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(9, 0, 120).alias("day"), F.lit(1).alias("least")),
        F.struct(F.lit("remove").alias("action"), day(13, 120, 120).alias("day"), F.lit(2).alias("least")),
        F.struct(F.lit("add").alias("action"), day(17, 240, 120).alias("day"), F.lit(3).alias("least")),
    )
    return keys.withColumn("step", F.explode(F.filter(steps, lambda s: s["least"] <= turn))).select("list", "step.action", "key", "step.day")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters(captures(pages), list_entries(pages))


_URL_SQL = r"""
WITH c AS (
  SELECT page_id, url, (DATE '2024-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 4))::INT % 365))::DATE AS fetch_day,
         nullif(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)), '^www\.|\.$', '', 'g'), '') AS host,
         list_filter(string_split(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), k AS (
  SELECT page_id, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, least(len(parts), 2) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))))) AS key
  FROM c WHERE host IS NOT NULL
), n AS (
  SELECT host AS key, 'block' AS list FROM c WHERE host IS NOT NULL
  UNION SELECT host || '/' || parts[1], 'allow' FROM c WHERE host IS NOT NULL AND len(parts) > 0
  UNION SELECT array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 1, 1):], '.'), 'block' FROM c WHERE host IS NOT NULL
), h AS (
  SELECT *, ('0x' || substr(md5(key), 5, 4))::INT % 4 AS turn, DATE '2024-01-01' + ('0x' || substr(md5(key), 9, 4))::INT % 120 AS a,
         DATE '2024-01-01' + 120 + ('0x' || substr(md5(key), 13, 4))::INT % 120 AS b, DATE '2024-01-01' + 240 + ('0x' || substr(md5(key), 17, 4))::INT % 120 AS d
  FROM n
), v AS (
  SELECT list, key, a AS f, CASE WHEN turn >= 2 THEN b END AS t FROM h WHERE turn >= 1
  UNION ALL SELECT list, key, d, NULL FROM h WHERE turn >= 3
), m AS (
  SELECT c.page_id, v.key, v.list, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.key) DESC, v.list = 'allow' DESC, v.key DESC) AS r, count(*) OVER (PARTITION BY c.page_id) AS n
  FROM c JOIN k USING (page_id) JOIN v ON v.key = k.key AND v.f <= c.fetch_day AND (v.t IS NULL OR c.fetch_day < v.t)
)
SELECT c.page_id, c.url, c.fetch_day, coalesce(m.n, 0)::BIGINT AS n_active, m.key AS matched_key, coalesce(m.list, 'none') AS verdict, coalesce(m.list, 'none') <> 'block' AS kept
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "first")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("base")
    counts = (n_of(base, k).alias(f"n_{k}") for k in BASE_KINDS)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n_of(F.col("spans"), "secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    names, profiles = learn(docs.filter(~held_out()), F.col("lang"), F.col("text"))
    return identify(docs, {"doc_id": F.col("doc_id"), "held_out": held_out()}, F.col("text"), names, profiles)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = text_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(features, train(features, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, items)
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))),
o AS (SELECT doc_id, i, g.m, item_id FROM g JOIN p ON g.m = p.m AND g.g = p.g),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS x FROM o GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.x, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

def _mix_sql(documents: str = "documents") -> str:
    """Targets, schedule and stream of the mix; a document's words are the overlap of its stretch, pass by pass, with the source's slots."""
    return f"""
d0 AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17|' || doc_id::VARCHAR || '|' || text), 1, 15))::BIGINT AS h FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS size FROM d0 GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w, 3 * size AS cap, (SELECT sum(size) FROM s0)::BIGINT AS total FROM s0),
s2 AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s1),
s3 AS (SELECT *, cap * ws <= rest * w AS capped FROM s2),
s4 AS (SELECT s3.*, CASE WHEN capped THEN cap::DOUBLE ELSE f.r::DOUBLE * w / f.v END AS target FROM s3 LEFT JOIN (SELECT rest AS r, ws AS v FROM s3 WHERE NOT capped ORDER BY cap / w, source NULLS LAST LIMIT 1) f ON true),
b AS (SELECT greatest(1, ceil(max(total) / greatest(65536, 1024 * count(*)))::BIGINT) AS block, max(total) AS total FROM s4),
r0 AS (SELECT source, sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () AS high, target FROM s4 WHERE target > 0),
p AS (SELECT slot, (((slot % 2147483648) * 1327217885 + 663608942) % 2147483648) / 2147483648.0::DOUBLE AS point FROM (SELECT unnest(range(0, ceil(total / block)::BIGINT)) AS slot FROM b)),
k AS (SELECT arg_min(source, high) AS source FROM p, r0 WHERE high >= point OR high > 0.999999999 GROUP BY slot),
n AS (SELECT source, count(*) AS slots FROM k GROUP BY source),
d1 AS (SELECT d0.*, s4.size AS source_size, s4.target, coalesce(n.slots, 0) * b.block AS stream,
         coalesce(sum(d0.size) OVER (PARTITION BY d0.source ORDER BY h, doc_id, d0.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
       FROM d0 JOIN s4 ON d0.source IS NOT DISTINCT FROM s4.source LEFT JOIN n ON d0.source IS NOT DISTINCT FROM n.source, b),
mixed AS (SELECT *, list_sum(list_transform([0, 1, 2], lambda q: greatest(0, least(q * source_size + at_ + size, stream) - (q * source_size + at_))))::BIGINT AS taken FROM d1)"""


_MIXING_SQL = f"WITH {_mix_sql()} SELECT doc_id, size, source_size, target, taken FROM mixed"


QUERIES = {"op1_url_filters": op1_url_filters, "op3_mix_sources": op3_mix_sources, "op5_personal_data": op5_personal_data, "op2_jaccard_join": op2_jaccard_join, "op4_html_text": op4_html_text, "op6_decontaminate": op6_decontaminate, "op7_language_id": op7_language_id, "op9_quality_model": op9_quality_model, "op8_quality_rules": op8_quality_rules, "op10_token_files": op10_token_files}

ORACLE_SQL = {"op1_url_filters": _URL_SQL, "op3_mix_sources": _MIXING_SQL, "op6_decontaminate": _CONTAMINATION_SQL, "op8_quality_rules": _quality_sql()}
