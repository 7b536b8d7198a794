"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions alone.

Sources get targets by weight; a target stops at `most_passes` times its source's size and the excess goes to the others by weight.
The mix is a sequence of slots of `block` words. Slot i has the golden-ratio point frac((i + 1/2) / phi), mapped through the
cumulative targets to a source, so every stretch of the schedule holds each source close to its share. Slots are ranked within
their source; the k-th takes the k-th block of the source's stream, which is its documents in shuffled order, again
and again, cut into blocks of equal words. Documents and slots meet by (source, block).

The schedule gives a source a few slots more or less than its target asks for. For a source whose target is under `few` slots
that is too much: it gets the slots that it lacks, and its stream is cut at its rounded target, so even a target under one block is taken whole.

Positions within a source are prefix sums in two levels (sums of hash buckets, then rows inside one bucket), and ranks of slots
likewise, so a source with a third of all rows is spread over as many tasks as it has buckets.

Defined results: null and empty texts have size 0 and are never taken; null is a source of its own, after all others; repeated
rows are documents of their own; rows that tie in the shuffled order are equal rows; a source of size 0 has target 0; a text of any length is one document, which many
slots may take in turn; an empty table gives no rows; of the input's columns only id, source and a hash of the text come back, so no names clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stage
from gridloom.operators.joins import salted_join

# Fixed values of the result contract.
WORD_GAPS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

#: Golden-ratio points in integers: slot i is at (i + 1/2) * _STEP mod 2^31, where _STEP is the odd number nearest to 2^31 / phi.
_MODULUS, _STEP = 1 << 31, 1327217885


@dataclass(frozen=True)
class Mix:
    """documents: _id, _source, _text_key (a hash of the text), _size, _source_size, _target, _at (place in the source's stream).
    pieces: per document row, named by _source and _at, and block taken: slot and words."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def n_words(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda x: x != "")
    return F.size(words).cast("long")


def targets(sources: DataFrame, weight: Column, total: Column, most_passes: int = 3) -> DataFrame:
    """sources (one row each: source, size) with target: total by weight, none above most_passes * size.

    In ascending order of size / weight the sources that stop at their limit come first, so one running sum finds them.
    """
    s = sources.withColumn("_w", weight).withColumn("_cap", F.lit(most_passes) * F.col("size")).withColumn("_total", total)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rest = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    s = s.withColumn("_rest", rest).withColumn("_ws", F.sum("_w").over(after))
    s = s.withColumn("_capped", F.col("_cap") * F.col("_ws") <= F.col("_rest") * F.col("_w"))
    # The first source that is not at its limit fixes what is left for it and all after it.
    first = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.first(F.when(~F.col("_capped"), F.struct("_rest", "_ws")), ignorenulls=True).over(first)
    s = s.withColumn("_left", left)
    share = F.col("_left._rest").cast("double") * F.col("_w") / F.col("_left._ws")
    return s.withColumn("target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share)).drop("_w", "_cap", "_total", "_rest", "_ws", "_capped", "_left")


def by_rank(weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weights in turn over the sources by code point, null last."""
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return F.element_at(F.array(*(F.lit(w) for w in weights)), (at + 1).cast("int")).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, least_slots: int = 1 << 16, most_passes: int = 3, bucket_rows: int = 4096, seed: int = 17, few: int = 512) -> Mix:
    """The whole mix; its length is the size of all documents. The schedule has at least `least_slots` slots and 1024 per source,
    so that a source's words differ from its target by a few slots at every scale; below `few` slots they equal the rounded target."""
    text = F.col(f"`{text_col}`")
    docs = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), F.xxhash64(text).alias("_text_key"), n_words(text).alias("_size"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string"), text).cast("binary")), 1, 15), 16, 10).cast("long").alias("_hash"),
    )
    docs = stage(docs, "sizes")
    sources = docs.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("size"), F.count("*").alias("_rows"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    sources = stage(targets(sources, by_rank() if weight is None else weight, total, most_passes), "sources")
    # Buckets of the shuffled order: as many per source as its rows ask for, so a bucket's rows fit one task at any scale.
    n, words = sources.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, -(-words // max(least_slots, 1024 * n)))
    if n <= 10_000:  # a row each; checked
        placed = docs.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    else:
        keys = lambda c: {"_none": F.col(c).isNull(), "_some": F.coalesce(c, F.lit(""))}
        placed = salted_join(docs.withColumns(keys("_source")), sources.withColumns(keys("source")).drop("source"), ["_none", "_some"], "_rows", docs.count()).drop("_none", "_some")
    buckets = F.greatest(F.ceil(F.col("_rows") / bucket_rows), F.lit(1)).cast("long")
    placed = stage(placed.withColumn("_bucket", F.shiftright(F.shiftright("_hash", 28) * buckets, 32)), "placed")
    sums = placed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    base = _running(sums, "_bucket", "_sum", "_base").select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_base")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.join(base, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    placed = placed.select("_id", "_source", "_text_key", "_size", F.col("size").alias("_source_size"), F.col("target").alias("_target"), (F.col("_base") + F.col("_inside")).alias("_at"))
    return Mix(placed, sources, _pieces(placed, _slots(sources, block, few, max(1024, 4 * n)), block, most_passes, few))


def _running(sums: DataFrame, key: str, value: str, out: str, wide: int = 1024) -> DataFrame:
    """Exclusive prefix sums of `value` by `key` within a source, in two levels of `wide` keys each."""
    s = sums.withColumn("_hi", F.floor(F.col(key) / wide))
    upper = s.groupBy("_source", "_hi").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy("_source").orderBy("_hi").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("_before", F.coalesce(F.sum("_t").over(w), F.lit(0))).select(F.col("_source").alias("_us"), F.col("_hi").alias("_uh"), "_before")
    w = Window.partitionBy("_source", "_hi").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    s = s.join(upper, F.col("_source").eqNullSafe(F.col("_us")) & (F.col("_hi") == F.col("_uh")))
    return s.withColumn(out, F.col("_own") + F.col("_before")).drop("_us", "_uh", "_hi", "_own", "_before")


def _slots(sources: DataFrame, block: int, few: int, cells: int) -> DataFrame:
    """The schedule: slot, _source, rank of the slot within its source (from 0), and the source's size. cells: a few times the sources, so a cell holds few ranges."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("size").alias("t")).first().t or 0
    n = -(-total // block)
    run = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    all_ = F.sum("target").over(Window.partitionBy(F.lit(0)))
    ranges = sources.filter("target > 0").withColumn("_high", F.sum("target").over(run) / all_).withColumn("_low", F.col("_high") - F.col("target") / all_)
    # Points and ranges meet by cell of the unit interval, so no range join is needed.
    last = F.lit(cells - 1)
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(F.least(F.floor(F.col("_low") * cells), last), F.least(F.floor(F.col("_high") * cells), last))))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(_MODULUS)) * F.lit(_STEP) + F.lit(_STEP // 2), F.lit(_MODULUS)) / F.lit(float(_MODULUS))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("_point", point).withColumn("_cell", F.least(F.floor(F.col("_point") * cells), last))
    # Two ranges that share a bound may both, or neither, hold a point by rounding: the lower one that reaches it wins.
    met = slots.join(ranges, "_cell").filter("_high >= _point OR _high > 0.999999999").groupBy("slot").agg(F.min(F.struct("_high", F.struct(F.col("source").alias("s"), F.col("size").alias("z")))).alias("m"))
    met = met.select("slot", F.col("m.col2.s").alias("_source"), F.col("m.col2.z").alias("_z"))
    chunk = met.withColumn("_chunk", F.floor(F.col("slot") / 4096))
    counts = chunk.groupBy("_source", "_chunk").agg(F.count("*").alias("_n"))
    base = _running(counts, "_chunk", "_n", "_base").select(F.col("_source").alias("_cs"), F.col("_chunk").alias("_cc"), "_base")
    own = F.row_number().over(Window.partitionBy("_source", "_chunk").orderBy("slot")) - 1
    ranked = chunk.withColumn("_own", own).join(base, F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_chunk") == F.col("_cc")))
    ranked = ranked.select("slot", "_source", "_z", (F.col("_own") + F.col("_base")).alias("rank"))
    # Slots that a small source lacks, each where an even spread of its ranks has it; they share the number of a slot there.
    have = counts.groupBy("_source").agg(F.sum("_n").alias("_have")).withColumnRenamed("_source", "_hs")
    small = sources.filter(F.col("target") < few * block).withColumn("_need", F.ceil(F.round("target") / block)).join(have, F.col("source").eqNullSafe(F.col("_hs")), "left")
    small = small.withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_need > _have").withColumn("rank", F.explode(F.sequence("_have", F.col("_need") - 1)))
    shift = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    more = small.select(F.floor((F.col("rank") + shift) / F.col("_need") * n).alias("slot"), F.col("source").alias("_source"), F.col("size").alias("_z"), "rank")
    return ranked.unionByName(more)


def _pieces(placed: DataFrame, slots: DataFrame, block: int, most_passes: int, few: int) -> DataFrame:
    """Every stretch of a document that a slot takes: _source, _at (which name the row), slot, words."""
    each = placed.filter("_size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
    start = F.col("_pass") * F.col("_source_size") + F.col("_at")
    goal = F.when(F.col("_target") < few * block, F.round("_target").cast("long"))
    each = each.withColumn("_start", start).withColumn("_end", F.least(start + F.col("_size"), goal)).filter("_start < _end")
    each = each.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    each = each.select("_source", "_at", "_pass", "_block", "_start", "_end")
    met = each.join(slots.select(F.col("_source").alias("_ss"), F.col("rank"), "slot"), F.col("_source").eqNullSafe(F.col("_ss")) & (F.col("_block") == F.col("rank")))
    words = F.least("_end", (F.col("_block") + 1) * block) - F.greatest("_start", F.col("_block") * block)
    return met.select("_source", "_at", "_pass", "slot", words.alias("words"))


def taken(m: Mix) -> DataFrame:
    """The documents of the mix with _taken: the words that it takes of each, repeats counted."""
    sums = m.pieces.groupBy(F.col("_source").alias("_ps"), F.col("_at").alias("_pa")).agg(F.sum("words").alias("_taken"))
    some, none = m.documents.filter("_size > 0"), m.documents.filter("_size = 0")
    got = some.join(sums, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_at") == F.col("_pa")), "left").drop("_ps", "_pa")
    return got.withColumn("_taken", F.coalesce("_taken", F.lit(0).cast("long"))).unionByName(none.withColumn("_taken", F.lit(0).cast("long")))
