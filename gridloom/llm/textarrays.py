"""Array views of whole text batches: word bounds and word hashes without a loop over documents.

All functions take the UTF-8 bytes of consecutive texts and their offsets. Word classes are byte classes, so a class that
holds every byte from 0x80 on is the same class of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}

#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters and digits of ASCII and every byte of other code points, after LOWER.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: All but space, tab, line feed, vertical tab, form feed, carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `most` bytes together; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
        _powers["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    return _powers["up"][:n], _powers["down"]


def bounds(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of set flags inside a text, and the index of each text's first run (one more at the end)."""
    n = len(flag)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (cut[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (cut[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of the bytes (or small integers) of each span, by differences of one prefix sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(buf) > block:  # bounded memory: spans block by block, each with the bytes that it covers
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
            lo, hi = starts[i], ends[j - 1]
            out[i:j] = span_hashes(buf[lo:hi], starts[i:j] - lo, ends[i:j] - lo, max(block, int(hi - lo)))
            i = j
        return out
    up, down = _power(len(buf))
    value = _powers["byte"][buf] if buf.dtype == np.uint8 else mix(buf.astype(np.uint64) + _BASE)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = ALNUM, lower: bool = True):
    """(hash of each word, index of each text's first word with one more at the end, starts, ends)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = bounds(kind[buf], off)
    return span_hashes(buf, starts, ends), first, starts, ends


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words of a text and index of each text's first one; a text of fewer words has one of all it has."""
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(per)])
    total = int(start[-1])
    doc = np.repeat(np.arange(len(count)), per)
    at = np.arange(total) - start[doc] + first[doc]
    length = np.minimum(width, count)[doc]
    out = np.zeros(total, np.uint64)
    last = len(hashes) - 1
    for j in range(width):
        use = j < length
        out = np.where(use, mix(out * _BASE + hashes[np.minimum(at + j, max(last, 0))] + np.uint64(j + 1)) if total else out, out)
    return out, start
