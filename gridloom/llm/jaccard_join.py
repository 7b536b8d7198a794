"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; a text's set is its 5-word shingles (a
text of 1 to 4 words is one shingle). Texts of the same words are one node, whatever ids their rows have, so copies cost one
aggregation and never meet in pairs. Nodes are told apart by 128 bits of their words and numbered in a written table.

The forest has `trees` prefix tries; a node's label in each is `depth` minima of its shingle hashes, in order. Nodes match where a
prefix of their labels is equal: first the whole labels, then the prefix shortened to the longest length that catches a share `recall`
of the pairs exactly at the threshold, and so at least that share of the pairs of any similarity. A pair belongs to the first
bucket that it shares, longest prefixes first; pairs whose set sizes rule the threshold out are left before any text moves; the others
are verified once, by the exact Jaccard index of both sets. Matched pairs stay inside a task, which returns a link count per
node and a star of edges.

Buckets of any size are dealt in blocks of at most about `block` members and `block_shingles` shingles, and every pair of blocks is
a group of its own, so no task holds an unbounded bucket and no pair is left out. Keys with very many rows are salted in every join.

Defined results: null and empty texts, and texts without a word, are in a class of their own with no link; rows that share an id but not their
words are different nodes with links of their own; rows with a null id link like any other, and a class has the smallest id that it holds, null if it
has none; repeated rows each get a result row; a very long text is one node like any other, its words are held in memory at once; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import release, small_batches, stage
from gridloom.llm.textarrays import mix, pieces, shingles, utf8, words
from gridloom.operators.components import star_components
from gridloom.operators.joins import salted_join

_GROUP = ("key", "bi", "bj")


def _multipliers(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty((0, width), dtype)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(column), width)


def _signatures(batches: Iterator[pa.RecordBatch], width: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Per row: the columns before the text, 128 bits of its words (fa, fb), its distinct shingles (size) and their minima (sig); null without a word."""
    a, b = _multipliers(hashes)
    for batch in batches:
        buf, off = utf8(batch.column(batch.num_columns - 1))
        for i, j in pieces(off, 1 << 18):
            word, first, _, _ = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            none = np.diff(first) == 0
            # Order-dependent sums of mixed words: equal exactly for equal word sequences, up to 128-bit chance.
            place = (np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
            finger = []
            for k in range(2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word + mix(place * np.uint64(2) + np.uint64(k))))])
                finger.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            shingle, start = shingles(word, first, width)
            x = (shingle >> np.uint64(32)).astype(np.uint32)
            sig = np.zeros((j - i, hashes), np.uint32)
            size = np.zeros(j - i, np.int64)
            if not none.all():
                at = start[:-1][~none]
                for k in range(hashes):
                    sig[~none, k] = np.minimum.reduceat(x * a[k] + b[k], at)
                doc = np.repeat(np.arange(j - i), np.diff(start))
                order = np.lexsort((shingle, doc))
                shingle, doc = shingle[order], doc[order]
                size = np.bincount(doc[np.r_[True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])]], minlength=j - i)
            rest = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
            packed = pc.if_else(pa.array(none), pa.scalar(None, pa.binary()), _binary(sig))
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(f, mask=none) for f in finger), pa.array(size), packed], names=[*batch.schema.names[:-1], "fa", "fb", "size", "sig"])


def _prefix_keys(sig: np.ndarray, trees: int, depth: int, length: int) -> np.ndarray:
    """One 64-bit key per tree from the first `length` minima of its label."""
    label = sig.reshape(len(sig), trees, depth)[:, :, :length].astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)), label.shape[:2]).copy()
    for d in range(length):
        key = mix(key ^ mix(label[:, :, d] + np.uint64(d + 1)))
    return key


def _keys(batches: Iterator[pa.RecordBatch], trees: int, depth: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """node, size and the node's bucket keys: those of all trees for the longest prefix, then for the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            sig = _matrix(part.column(2), np.uint32, trees * depth)
            keys = np.concatenate([_prefix_keys(sig, trees, depth, k) for k in lengths], axis=1).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed, _binary(keys)], names=["node", "size", "keys", "all"])


def _heads(t: pa.Table) -> np.ndarray:
    """First row of each group (key, bi, bj)."""
    key, bi, bj = (t.column(c).to_numpy() for c in _GROUP)
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a group ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = int(_heads(t)[-1])
        if last:
            yield t.slice(0, last).combine_chunks()
            t = t.slice(last)
        rest = t
    if rest is not None:
        yield rest.combine_chunks()


def _slices(t: pa.Table, most: int = 1 << 20) -> Iterator[pa.Table]:
    """t in parts of whole groups with at most `most` bytes of text each; a larger group is a part of its own, and blocks bound it."""
    start = _heads(t)
    size = np.add.reduceat(pc.fill_null(pc.binary_length(t.column("text")), 0).to_numpy().astype(np.int64), start)
    at, held = 0, 0
    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        if held and held + n > most:
            yield t.slice(at, s - at).combine_chunks()
            at, held = s, 0
        held += n
    yield t.slice(at).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    column = t.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _first_matches(t: pa.Table, buckets: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of each group whose first common bucket is this group's and whose set sizes allow the threshold: all of a block, or one of each of two blocks."""
    bi, bj, side, tree = (t.column(c).to_numpy() for c in ("bi", "bj", "side", "tree"))
    size = t.column("size").to_numpy().astype(float)
    n = t.num_rows
    seen = _matrix(_column(t, "all"), np.int64, buckets)
    start = _heads(t)
    many = np.diff(np.r_[start, n])
    end = np.repeat(start + many, many)
    cross = bi != bj
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.repeat(many <= 48, many)
    rows = np.arange(n)
    for d in range(1, 48):
        i = rows[small & (rows + d < end)]
        if not len(i):
            break
        j = i + d
        ok = (~cross[i] | (side[i] != side[j])) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6)
        i, j = i[ok], j[ok]
        ok = (seen[i] == seen[j]).argmax(axis=1) >= tree[i]  # equal at this bucket, so there is a first equal one
        out_i.append(i[ok])
        out_j.append(j[ok])
    for s, m in zip(start[many > 48].tolist(), many[many > 48].tolist(), strict=True):
        cut = int(np.searchsorted(side[s : s + m], 1)) if cross[s] else 0
        left, right = (slice(s, s + cut), slice(s + cut, s + m)) if cross[s] else (slice(s, s + m), slice(s, s + m))
        x, y = size[left][:, None], size[right][None, :]
        new = np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-6
        for c in range(int(tree[s])):
            new &= seen[left, c][:, None] != seen[right, c][None, :]
        i, j = np.nonzero(new if cross[s] else np.triu(new, 1))
        out_i.append(i + s)
        out_j.append(j + s + cut)
    return np.concatenate(out_i), np.concatenate(out_j)


def _needed(batches: Iterator[pa.RecordBatch], buckets: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that are in any pair to verify."""
    for t in _whole_groups(batches):
        i, j = _first_matches(t, buckets, threshold)
        if len(i):
            yield from t.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches(max_chunksize=4096)


def _intersections(i: np.ndarray, j: np.ndarray, sets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets i and j, for each pair; i ascends. sets: numbers of the members, set after set."""
    size = np.diff(start)
    mark = np.zeros(int(sets.max()) + 1 if len(sets) else 1, bool)
    out = np.zeros(len(i), np.int64)
    left, at = np.unique(i, return_index=True)
    for a, lo, hi in zip(left.tolist(), at.tolist(), np.r_[at[1:], len(i)].tolist(), strict=True):
        partners = j[lo:hi]
        own = sets[start[a] : start[a + 1]]
        mark[own] = True
        if len(partners) == 1:
            p = partners[0]
            out[lo] = np.count_nonzero(mark[sets[start[p] : start[p + 1]]])
        else:
            m = size[partners]
            done = np.cumsum(m) - m
            members = sets[np.repeat(start[partners] - done, m) + np.arange(int(m.sum()))]
            out[lo:hi] = np.add.reduceat(mark[members].astype(np.int64), done)
        mark[own] = False
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest node that each row reaches over the pairs."""
    root = node.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if np.array_equal(before, root):
            return root


def _verify(batches: Iterator[pa.RecordBatch], buckets: int, width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for t in (part for whole in _whole_groups(batches) for part in _slices(whole)):
        i, j = _first_matches(t, buckets, threshold)
        if not len(i):
            continue
        names, one, row = np.unique(t.column("node").to_numpy(), return_index=True, return_inverse=True)
        word, first, _, _ = words(*utf8(_column(t, "text").take(pa.array(one))))
        shingle, start = shingles(word, first, width)
        number = np.unique(shingle, return_inverse=True)[1]
        top = int(number.max()) + 1
        member = np.unique(np.repeat(np.arange(len(names)), np.diff(start)) * top + number)
        start = np.searchsorted(member // top, np.arange(len(names) + 1))
        a, b = row[i], row[j]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        both = _intersections(a, b, member % top, start)
        size = np.diff(start)
        ok = both >= (threshold - 1e-12) * (size[a] + size[b] - both)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        links = np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
        root = _roots(len(names), a, b, names)
        has = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(names[has]), pa.array(root[has]), pa.array(links[has])], names=["node", "root", "links"])


def chance(similar, trees: int, length: int):
    """That two sets so similar share a prefix of this length in some tree."""
    return 1 - (1 - similar**length) ** trees


def least_length(threshold: float, trees: int, length: int, recall: float) -> int:
    """The longest prefix, up to `length`, that catches a share `recall` of the pairs at the threshold itself."""
    return max([1, *(k for k in range(1, length + 1) if chance(threshold, trees, k) >= recall)])


def jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 8, recall: float = 0.9995,
    block: int = 1024, block_shingles: int = 1 << 19,
) -> DataFrame:
    """One row per row of df: doc_id, class_id (smallest id of all that links and copies join), copy_of (smallest id of the
    same words), n_copies (rows of the same words), n_links (different texts at least `threshold` similar), text_key (a hash
    that tells texts of one id apart) and first (the row is the one that stands for its class; rows equal to it in id and text are it too)."""
    lengths = sorted({depth, least_length(threshold, trees, depth, recall)}, reverse=True)
    buckets = trees * len(lengths)
    text = F.col(f"`{text_col}`")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    with small_batches(df.sparkSession):
        signed = stage(docs.mapInArrow(lambda b: _signatures(b, width, trees * depth), "id long, text_key long, fa long, fb long, size long, sig binary"), "signatures")
        total = signed.count()
        some = signed.filter("sig IS NOT NULL")
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key"))
        nodes = some.groupBy("fa", "fb").agg(F.count("*").alias("n_copies"), F.max("size").alias("size"), F.max("sig").alias("sig"), first.alias("first"))
        nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once the table is written
        keyed = stage(nodes.select("node", "size", "sig").mapInArrow(lambda b: _keys(b, trees, depth, lengths), "node long, size long, keys array<long>, all binary"), "keyed")

        rows = keyed.select("node", "size", F.posexplode("keys").alias("tree", "key"))
        counts = stage(rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("size").alias("s")).filter("c > 1"), "buckets")
        members = salted_join(rows, counts, ["key"], "c", total * buckets)
        blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("s") / block_shingles)).cast("int")
        dealt = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = (F.col("own") > F.col("other")).cast("int")
        dealt = dealt.select("node", "size", "tree", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), side.alias("side"))
        together = lambda x: x.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "side", "node")
        light = together(dealt.join(keyed.select("node", "all"), "node"))
        needed = stage(light.mapInArrow(lambda b: _needed(b, buckets, threshold), light.schema), "needed")

        wanted = needed.select("node").distinct().join(nodes.select("node", "n_copies", "first.no_id", F.coalesce("first.id", F.lit(0)).alias("own_id"), "first.text_key"), "node")
        texts = docs.withColumns({"no_id": F.col("id").isNull(), "own_id": F.coalesce("id", F.lit(0))})
        texts = salted_join(texts, stage(wanted, "wanted"), ["no_id", "own_id", "text_key"], "n_copies", total, hint="merge").groupBy("node").agg(F.max("text").alias("text"))
        heavy = together(needed.join(texts, "node"))
        links = stage(heavy.mapInArrow(lambda b: _verify(b, buckets, width, threshold), "node long, root long, links long"), "links")
        release(keyed, counts, needed)

    roots = stage(star_components(links.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots")
    named = nodes.select("node", "first").join(roots, "node")
    best = named.groupBy("root").agg(F.min("first").alias("class_first"), F.count("*").alias("n_nodes"))
    joined = salted_join(named.select("node", "root"), best, ["root"], "n_nodes", total).select("node", "class_first")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = nodes.select("fa", "fb", "node", "n_copies", "first").join(joined, "node", "left").join(counts, "node", "left")
    classes = stage(classes.select("fa", "fb", "n_copies", "first", F.coalesce("class_first", "first").alias("class_first"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    found = salted_join(some.drop("size", "sig"), classes, ["fa", "fb"], "n_copies", total)
    found = found.select(F.col("id").alias("doc_id"), F.col("class_first.id").alias("class_id"), F.col("first.id").alias("copy_of"), "n_copies", "n_links", "text_key", own.eqNullSafe(F.col("class_first")).alias("first"))
    alone = signed.filter("sig IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), "text_key", F.lit(True).alias("first"))
    return found.union(alone)
