"""Benchmark decontamination: an FM-index per shard of training text finds every occurrence of every test phrase.

A test phrase is a window of `width` consecutive words of a benchmark item; an item of fewer words, but not none, is one
phrase. Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A shard is a run of documents of
one partition. Only runs of words that all occur in the benchmark, at least as long as the shortest phrase, can hold an
occurrence, so these runs make up the indexed string; nothing that could match is left out. Backward search counts the
occurrences of all phrases at once, sampled suffix positions locate them, and overlapping occurrences merge into spans.

The benchmark is broadcast in groups of items of at most `most_chars` characters: a small benchmark takes one pass over the
documents; for a larger one the rows are numbered in a written table, each group takes a pass, and what the passes found of a row is
united by its number, so the result is the same for every size of the groups. Nothing is capped.

Defined results: null and empty texts have no words, no hits and no items; a null item id is shown as an empty string;
repeated rows, rows with equal ids and rows with a null id each get their own result; equal item ids count once; a very long text is a shard
of its own; an empty benchmark finds nothing; empty tables give empty tables; columns that clash are not touched, since the result has
only the document id and the struct fields named here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.fm_index import FMIndex
from gridloom.llm.shared import stage
from gridloom.llm.textarrays import pieces, utf8, words

FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class Phrases:
    """All phrases of a group of items as rows of word numbers, and the items of each."""

    def __init__(self, rows: list[tuple[str, str]], width: int):
        self.ids = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(self.ids)}
        hashes, first, _, _ = words(*utf8(pa.array([t for _, t in rows], pa.large_string())))
        self.vocabulary = np.unique(hashes)
        numbered = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        own = np.array([number[i] for i, _ in rows], np.int64)
        count = np.diff(first)
        size = np.minimum(width, count)
        self.by_size = []
        for n in np.unique(size[size > 0]).tolist():
            which = np.flatnonzero(size == n)
            per = count[which] - n + 1
            at = np.repeat(first[which] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            patterns, same = np.unique(numbered[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pair = np.unique(same.reshape(-1) * len(self.ids) + np.repeat(own[which], per))
            self.by_size.append((patterns, np.searchsorted(pair // len(self.ids), np.arange(len(patterns) + 1)), pair % len(self.ids)))
        self.shortest = self.by_size[0][0].shape[1] if self.by_size else 0


def scan_shard(numbers: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered words as a flag, and (document, item) pairs found. numbers: each word's number in the benchmark, 0 if it has none."""
    n = len(numbers)
    covered = np.zeros(n, bool)
    none = np.empty(0, np.int64)
    if not n or not phrases.by_size:
        return covered, none, none
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    known = numbers > 0
    start = np.flatnonzero(known & (cut[:-1] | ~np.r_[False, known[:-1]]))
    stop = np.flatnonzero(known & (cut[1:] | ~np.r_[known[1:], False])) + 1
    long = stop - start >= phrases.shortest
    start, stop = start[long], stop[long]
    if not len(start):
        return covered, none, none
    size = stop - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(start - at[:-1], size) + np.arange(at[-1])  # the word of each indexed symbol; a run's last one is its end
    symbols = np.zeros(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    symbols[inner] = numbers[source[inner]]
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    change = np.zeros(n + 1, np.int64)
    docs, items = [], []
    present = np.bincount(symbols, minlength=len(phrases.vocabulary) + 1) > 0
    for patterns, item_at, item_of in phrases.by_size:
        possible = np.flatnonzero(present[patterns].all(axis=1))  # the others lack a word here
        lo, hi = index.search(patterns[possible])
        hits = hi - lo
        which = np.repeat(possible, hits)
        if not len(which):
            continue
        rows = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        word = source[index.locate(rows)]
        np.add.at(change, word, 1)
        np.add.at(change, word + patterns.shape[1], -1)
        doc = np.searchsorted(first, word, "right") - 1
        pair = np.unique(doc * len(patterns) + which)
        doc, which = pair // len(patterns), pair % len(patterns)
        many = item_at[which + 1] - item_at[which]
        docs.append(np.repeat(doc, many))
        items.append(item_of[np.repeat(item_at[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
    covered = np.cumsum(change[:-1]) > 0
    if not docs:
        return covered, none, none
    pair = np.unique(np.concatenate(docs) * len(phrases.ids) + np.concatenate(items))
    return covered, pair // len(phrases.ids), pair % len(phrases.ids)


def _numbers(buf: np.ndarray, off: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number in the benchmark, 0 if it has none, and the first word of each text."""
    hashes, first, _, _ = words(buf, off)
    if not len(phrases.vocabulary):
        return np.zeros(len(hashes), np.int64), first
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    return np.where(phrases.vocabulary[at] == hashes, at + 1, 0), first


def _scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, found_only: bool) -> Iterator[pa.RecordBatch]:
    """row, n_words, spans and items of each row, or of those in which something is found."""
    names = pa.array(phrases.ids, pa.string())
    for batch in batches:
        buf, off = utf8(batch.column(1))
        for i, j in pieces(off):
            number, first = _numbers(buf[off[i] : off[j]], off[i : j + 1] - off[i], phrases)
            covered, docs, items = scan_shard(number, first, phrases)
            cut = np.zeros(len(covered) + 1, bool)
            cut[first] = True
            start = np.flatnonzero(covered & (cut[:-1] | ~np.r_[False, covered[:-1]])) if len(covered) else np.empty(0, np.int64)
            stop = np.flatnonzero(covered & (cut[1:] | ~np.r_[covered[1:], False])) + 1 if len(covered) else np.empty(0, np.int64)
            base = first[np.searchsorted(first, start, "right") - 1] if len(start) else start
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first), pa.int32()), pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], names=["start", "end"]))
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(len(first))), pa.int32()), names.take(pa.array(items, pa.int64())))
            made = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), spans, listed], names=[batch.schema.names[0], "n_words", "spans", "items"])
            yield made.take(pa.array(np.unique(docs))) if found_only else made


def _item_groups(items: DataFrame, id_col: str, text_col: str, most_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in groups of bounded size; one group comes to the driver at a time."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t") + F.length("i"))).first()[0] or 0
    groups = -(-total // most_chars)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(groups, 1)))
    for g in range(groups):
        yield [tuple(r) for r in rows.filter(part == g).collect()]


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_chars: int = 4 << 20) -> DataFrame:
    """Per document row: words, merged spans of covered words (start, exclusive end) and the items found."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spark, groups = docs.sparkSession, _item_groups(items, item_col, item_text_col, most_chars)
    share = lambda group: spark.sparkContext.broadcast(Phrases(group, width))
    scan = lambda rows, phrases, only: rows.mapInArrow(lambda b: _scan(b, phrases.value, only), f"{rows.columns[0]} long, {FOUND}")
    first, second = next(groups, []), next(groups, None)
    if second is None:
        return scan(own, share(first), False)
    numbered = stage(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    each = [scan(numbered.select("row", "text"), share(g), True) for g in chain([first, second], groups)]
    spans = F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    united = reduce(DataFrame.unionByName, each).groupBy("row").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = united.mapInArrow(_merged, "row long, spans array<struct<start:long,end:long>>, items array<string>")
    counted = scan(numbered.select("row", "text"), share([]), False).select("row", "n_words")
    none = {"spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")}
    met = numbered.select("row", "doc_id").join(counted, "row").join(united, "row", "left")
    return met.select("doc_id", "n_words", *(F.coalesce(k, x).alias(k) for k, x in none.items()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of each row united where they touch."""
    for batch in batches:
        made = []
        for spans in batch.column(1).to_pylist():
            out: list[dict] = []
            for s in spans:
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(s)
            made.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, batch.schema.field(1).type), batch.column(2)], names=["row", "spans", "items"])


def n_hit() -> Column:
    """Words inside any occurrence."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _clean(batches: Iterator[pa.RecordBatch], phrases: Phrases, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = utf8(batch.column(at))
        hit = np.zeros(batch.num_rows, bool)
        for i, j in pieces(off):
            number, first = _numbers(buf[off[i] : off[j]], off[i : j + 1] - off[i], phrases)
            _, docs, _ = scan_shard(number, first, phrases)
            hit[i + docs] = True
        yield batch.filter(pa.array(~hit))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_chars: int = 4 << 20) -> DataFrame:
    """The rows of docs without an occurrence of any phrase, with all their columns and no shuffle; what a group of items leaves is written before the next."""
    names, text = docs.columns, F.col(f"`{text_col}`")
    # The other columns travel as one struct, since names with dots are none that a Python stage takes.
    rows = docs.select(text.alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c != text_col)).alias("rest"))
    for k, group in enumerate(_item_groups(items, item_col, item_text_col, most_chars)):
        rows = stage(rows, "clean") if k else rows
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(group, width))
        rows = rows.mapInArrow(lambda batches, p=phrases: _clean(batches, p.value, 0), rows.schema)
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in names))
