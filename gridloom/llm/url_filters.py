"""URL filters by a temporal list join, with DataFrame functions alone.

A list is a table of dated entries: list, action ('add' or 'remove'), key, day. A key is a host suffix ('example.org',
'a.example.org') or a host with leading path segments ('a.example.org/en'). Entries become validity intervals [from, to): an
'add' opens one, the next entry of the same list and key closes it. A capture is compared with the entries active on the day it
was fetched: each of its keys (all suffixes of its host down to two labels, and its host with up to `path_depth` segments)
meets the intervals by equality of the key, and the one interval that holds the day remains.

The longest matching key decides, as it is the most specific; on equal keys the allow list wins over the block list. A capture
without a match is kept.

One host may have a third of all captures, so captures and intervals meet by key and salt: intervals, which are few against
captures, are repeated per salt. Captures without a key never enter the join. Matches are folded per capture by one partially aggregated groupBy.

Defined results: a null or unparsable URL, or a null day, has no key, verdict 'none' and is kept; of entries of one
list, key and day the 'remove' holds; entries with a null key, list or day are ignored; repeated captures are each judged; a very long URL is read
whole; empty tables are no special case; other columns are not carried, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"

_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without a leading www. or a trailing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.|\.$", "")
    return F.when(host != "", host)


def url_keys(url: Column, path_depth: int = 2) -> Column:
    """All list keys that a URL falls under."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    depth = F.least(F.size(parts), F.lit(path_depth))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, action, key, day) as validity intervals: list, key, valid_from, valid_to (null: still open)."""
    e = entries.filter("key IS NOT NULL AND list IS NOT NULL AND day IS NOT NULL")
    e = e.groupBy("list", "key", "day").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    order = Window.partitionBy("list", "key").orderBy("day")
    e = e.withColumn("valid_to", F.lead("day").over(order))
    return e.filter("action = 'add'").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def url_filters(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day", path_depth: int = 2, salts: int = 16) -> DataFrame:
    """One row per capture: id, url, day, n_active (entries active for it), matched_key, verdict (allow, block or none), kept."""
    c = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{day_col}`").alias("day"), F.monotonically_increasing_id().alias("row"))
    keyed = c.withColumn("key", F.explode_outer(url_keys(F.col("url"), path_depth)))
    keyed = keyed.withColumn("salt", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("row"), F.lit(1 << 30))).otherwise(F.pmod("row", F.lit(salts))).cast("int"))
    spread = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = keyed.join(spread, ["key", "salt"], "left")
    active = F.col("list").isNotNull() & (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    best = F.max(F.when(active, F.struct(F.length("key").alias("n"), (F.col("list") == ALLOW).alias("allow"), F.col("key").alias("key"))))
    folded = met.groupBy("id", "url", "day", "row").agg(F.count(F.when(active, 1)).alias("n_active"), best.alias("best"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), ALLOW).otherwise(BLOCK)
    return folded.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("day").alias(day_col), "n_active", F.col("best.key").alias("matched_key"), verdict.alias("verdict"), (verdict != BLOCK).alias("kept"))
