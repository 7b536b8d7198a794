"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a run of letters is bounded by a blank, a symbol of its own. An n-gram binds
its letters: the product of their vectors, each rotated by its distance from the n-gram's end. A text bundles (sums) its
n-gram vectors, a language bundles its texts, and a text gets the language with the largest cosine to its profile, less the part that all
profiles share. Vectors come from a counter-based generator, so every worker has the same ones without a broadcast.

Bundling is linear, so a language's profile is the sum over its distinct n-grams of count times vector, and partial profiles
of partitions are integers that one groupBy adds up exactly. For the same reason a long text is bundled segment by segment, and n-grams
go through their vectors a few thousand at a time, so a worker's memory depends neither on the longest text nor on the script. The
driver holds one profile, 8 KB, per language, however many there are.

Defined results: null texts and texts without a letter are 'und' with score 0; with nothing to learn from every text is 'und';
equal cosines go to the language that sorts first; very long texts count whole; repeated rows and other columns change nothing but counts;
empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.codepoints import decode, small_letters
from gridloom.llm.textarrays import mix, pieces, utf8

UNKNOWN = "und"
_BLANK = 32


def _letter_vectors(symbols: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """A vector of +1 and -1 for each symbol, by hashing (symbol, block of 64 places)."""
    words = -(-size // 64)
    key = symbols.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(words, dtype=np.uint64)[None, :] + np.uint64(seed << 50)
    bits = np.unpackbits(mix(mix(key)).view(np.uint8), axis=1)[:, :size]
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def _gram_vectors(grams: np.ndarray, n: int, size: int) -> np.ndarray:
    """grams: one packed n-gram each, 18 bits a letter, the first letter highest."""
    out = np.ones((len(grams), size), np.int8)
    for k in range(n):
        symbols, at = np.unique(grams >> np.uint64(18 * k) & np.uint64((1 << 18) - 1), return_inverse=True)
        out *= np.roll(_letter_vectors(symbols, size), k, axis=1)[at]
    return out


class Grams:
    """Vectors of the n-grams seen so far, at most `most`. A worker starts anew when fewer than half of a request are known."""

    def __init__(self, n: int, size: int, most: int = 1 << 14):
        self.n, self.size, self.most = n, size, most
        self.keys, self.vectors = np.empty(0, np.uint64), np.empty((0, size), np.int8)

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        """grams ascend. Rows of float32, which hold these integers exactly."""
        at = np.minimum(np.searchsorted(self.keys, grams), max(len(self.keys) - 1, 0))
        known = self.keys[at] == grams if len(self.keys) else np.zeros(len(grams), bool)
        out = np.empty((len(grams), self.size), np.float32)
        out[known] = self.vectors[at[known]]
        if not known.all():
            new = grams[~known]
            made = _gram_vectors(new, self.n, self.size)
            out[~known] = made
            if len(self.keys) + len(new) <= self.most:
                into = np.searchsorted(self.keys, new)
                self.keys, self.vectors = np.insert(self.keys, into, new), np.insert(self.vectors, into, made, axis=0)
            elif 2 * len(new) > len(grams) and len(new) <= self.most:
                self.keys, self.vectors = new, made
        return out


_memory: dict[tuple[int, int], Grams] = {}


def _grams(n: int, size: int) -> Grams:
    return _memory.setdefault((n, size), Grams(n, size))


def _counted(sym: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in grams, count) of each distinct n-gram of each text, and the distinct n-grams of all, ascending; d: the text of each symbol."""
    m = len(sym) - n + 1
    none = np.empty(0, np.int64)
    if m <= 0:
        return none, none, none, np.empty(0, np.uint64)
    gram = np.zeros(m, np.uint64)
    for k in range(n):
        gram = gram << np.uint64(18) | sym[k : k + m]
    inside = d[:m] == d[n - 1 :]
    gram, d = gram[inside], d[:m][inside]
    grams, at = np.unique(gram, return_inverse=True)
    pair, count = np.unique(d * max(len(grams), 1) + at, return_counts=True)
    return pair // max(len(grams), 1), pair % max(len(grams), 1), count, grams


def count_grams(buf: np.ndarray, off: np.ndarray, n: int):
    """The counts of _counted for whole texts."""
    cp, pos = decode(buf, off)
    low = small_letters(cp)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(pos))
    letter = low > 0
    cut = np.zeros(len(cp) + 1, bool)
    cut[pos] = True
    # One blank for each run of other code points, and one at each end of a text.
    keep = letter | np.r_[False, letter[:-1]][: len(cp)] & ~cut[:-1]
    sym, d = np.where(letter, low, _BLANK).astype(np.uint64)[keep], doc[keep]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, np.int64)
    sym, d = np.insert(sym, first, _BLANK), np.insert(d, first, d[first])
    stop = np.flatnonzero((sym != _BLANK) & np.r_[d[1:] != d[:-1], True]) + 1 if len(d) else np.empty(0, np.int64)
    sym, d = np.insert(sym, stop, _BLANK), np.insert(d, stop, d[stop - 1] if len(stop) else d[:0])
    return _counted(sym, d, n)


def count_segments(buf: np.ndarray, n: int, most: int):
    """The counts of count_grams for one long text, a segment of about `most` bytes at a time."""
    held, after_letter, at = np.empty(0, np.uint64), False, 0
    while at < len(buf):
        end = min(at + most, len(buf))
        while end < len(buf) and buf[end] & 0xC0 == 0x80:
            end += 1
        cp, _ = decode(buf[at:end], np.array([0, end - at]))
        low = small_letters(cp)
        letter = low > 0
        keep = letter | np.r_[after_letter, letter[:-1]][: len(cp)]
        sym = np.where(letter, low, _BLANK).astype(np.uint64)[keep]
        after_letter = bool(letter[-1]) if len(letter) else after_letter
        if len(sym) and not len(held):
            held = np.array([_BLANK], np.uint64)
        stream = np.concatenate([held, sym])
        at = end
        if at == len(buf) and len(stream) and stream[-1] != _BLANK:
            stream = np.append(stream, np.uint64(_BLANK))
        yield _counted(stream, np.zeros(len(stream), np.int64), n)
        held = stream[-(n - 1) :] if n > 1 else stream[-1:]


def bundles(buf: np.ndarray, off: np.ndarray, group: np.ndarray, groups: int, n: int, size: int, most: int = 1 << 18, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n-gram vectors over the texts of each group, and which texts have an n-gram. Texts of more than `most` bytes go segment by segment,
    n-grams `wide` at a time, so beside the result no more than a few times `most` and wide * size numbers are held."""
    total, some = np.zeros((groups, size)), np.zeros(len(off) - 1, bool)

    def add(doc, at, count, grams) -> None:
        for lo in range(0, len(grams), wide):
            use = (at >= lo) & (at < lo + wide)
            rows, place = np.unique(group[doc[use]], return_inverse=True)
            table = np.zeros((len(rows), min(wide, len(grams) - lo)), np.float32)
            np.add.at(table, (place, at[use] - lo), count[use])
            total[rows] += table @ _grams(n, size).vectors_of(grams[lo : lo + wide])

    for i, j in pieces(off, most):
        part = buf[off[i] : off[j]]
        whole = len(part) <= most
        for doc, at, count, grams in [count_grams(part, off[i : j + 1] - off[i], n)] if whole else count_segments(part, n, most):
            some[i + doc] = True
            add(i + doc, at, count, grams)
    return total, some


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _profiles(batches: Iterator[pa.RecordBatch], n: int, size: int, most_held: int = 256) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def held() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], names=["lang", "profile"])
        total.clear()
        return made

    for batch in (part for b in batches for part in _slices(b)):
        names, lang = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        made, _ = bundles(*utf8(batch.column(1)), lang, len(names), n, size)
        for name, row in zip(names.tolist(), made, strict=True):
            total[name] = total.get(name, 0) + np.rint(row).astype(np.int64)
        if len(total) > most_held:
            yield held()
    if total:
        yield held()


def learn(df: DataFrame, lang: Column, text: Column, n: int = 3, size: int = 1024) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit profiles. Every row of df with a language counts."""
    rows = df.select(lang.alias("lang"), text.alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(lambda b: _profiles(b, n, size), "lang string, profile array<long>")
    places = parts.select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    whole = places.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))
    sums = {r.lang: np.array(r.v, np.int64) for r in whole.toLocalIterator()}  # a row of `size` numbers per language
    names = sorted(k for k, v in sums.items() if np.any(v))
    profiles = np.array([sums[k] for k in names], np.float64).reshape(len(names), size)
    profiles /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    return names, profiles


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], profiles: np.ndarray, n: int, size: int, sharpness: float) -> Iterator[pa.RecordBatch]:
    common = profiles.mean(axis=0) if len(names) > 1 else np.zeros(size)
    own = profiles - common
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    for batch in (part for b in batches for part in _slices(b)):
        rows = batch.num_rows
        text, some = bundles(*utf8(batch.column(batch.num_columns - 1)), np.arange(rows), rows, n, size)
        if names:
            text = text / np.maximum(np.linalg.norm(text, axis=1, keepdims=True), 1e-12) - common
            cosine = (text / np.maximum(np.linalg.norm(text, axis=1, keepdims=True), 1e-12)) @ own.T
            best = cosine.argmax(axis=1)
            score = np.where(some, 1 / np.exp(sharpness * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1), 0.0)
            lang = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        else:
            lang, score = [UNKNOWN] * rows, np.where(some, 1.0, 0.0)
        rest = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.round(score, 9))], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def identify(df: DataFrame, keep: dict[str, Column], text: Column, names: list[str], profiles: np.ndarray, sharpness: float = 8.0, n: int = 3) -> DataFrame:
    """The columns `keep` (name to long or boolean column), lang_pred and score for each row."""
    own = df.select(*(c.alias(k) for k, c in keep.items()), text.alias("text"))
    schema = ", ".join(f"{k} {t}" for k, t in own.dtypes[:-1]) + ", lang_pred string, score double"
    size = profiles.shape[1]
    model = df.sparkSession.sparkContext.broadcast((names, profiles))
    return own.mapInArrow(lambda b: _predict(b, *model.value, n, size, sharpness), schema)
