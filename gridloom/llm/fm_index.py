"""FM-index over a shard of word numbers: suffix order, wavelet matrix with ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. Symbol 0 ends a run; each 0 is smaller than the next, so no comparison passes one.

    Prefix doubling that sorts again only the suffixes whose place is still open.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank[order] = head
    last = np.r_[new[1:], True]
    open_ = np.flatnonzero(~(new & last))
    k = 1
    while len(open_):
        at = order[open_]
        key = rank[np.minimum(at + k, n - 1)]  # a run's end follows within it, so at + k never passes the array's end while open
        group = rank[at]
        by = np.lexsort((key, group))
        at, key, group = at[by], key[by], group[by]
        order[open_] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        head = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = head
        last = np.r_[new[1:], True]
        open_ = open_[~(new & last)]
        k *= 2
    return order


class Wavelet:
    """Wavelet matrix: rank of any symbol before any place, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        x = symbols.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> np.uint32(level)) & np.uint32(1)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before place before[i]."""
        lo, hi = np.zeros(len(symbol), np.int64), before.astype(np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, self.zeros[level] + a, lo - a), np.where(bit, self.zeros[level] + b, hi - b)
        return hi - lo

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank before it."""
        lo, i, out = np.zeros(len(place), np.int64), place.astype(np.int64), np.zeros(len(place), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[i + 1] - ones[i]
            a, b = ones[lo], ones[i]
            lo, i = np.where(bit == 1, self.zeros[level] + a, lo - a), np.where(bit == 1, self.zeros[level] + b, i - b)
            out = out << 1 | bit
        return out, i - lo


class FMIndex:
    """symbols: word numbers from 1, each run closed by a 0; size: symbols there may be, with 0."""

    def __init__(self, symbols: np.ndarray, size: int, every: int = 16):
        order = suffix_order(symbols)
        n = len(symbols)
        before = symbols[order - 1]  # order 0 wraps to the last symbol, a 0
        self.wavelet = Wavelet(before, size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.n = n
        first_of_run = np.zeros(n, bool)
        first_of_run[0] = True
        first_of_run[1:] = symbols[:-1] == 0
        kept = (order % every == 0) | first_of_run[order]
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.sample = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of patterns at once: the range of suffixes that begin with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their place in the order: walk back to a sampled one. A run's first word is sampled, so no walk leaves its run."""
        out, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.kept[r]
            out[open_[done]] = self.sample[self.kept_before[r[done]]] + steps
            open_, r = open_[~done], r[~done]
            symbol, rank = self.wavelet.at(r)
            rows[open_] = self.less[symbol] + rank
            steps += 1
        return out
