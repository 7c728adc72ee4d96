"""A full-text index over token sequences: suffix order, wavelet ranks, sampled positions.

All operations work on whole arrays, for all patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes. symbols must end with, and be separated by, values that occur once.

    Several symbols are packed into one key for the first sort; then ranks of
    suffixes that are still equal are refined by doubling, those alone.
    """
    n = len(symbols)
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for i in range(width):
        part = np.zeros(n, np.int64)
        part[: max(n - i, 0)] = symbols[i:]
        key = (key << bits) | part
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    # a rank is the place of the first suffix of its group, so that groups can be refined in place
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = width
    while True:
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[first, n])
        group = np.repeat(sizes > 1, sizes)
        if not group.any():
            return order
        slots = np.flatnonzero(group)
        rows = order[slots]
        head, after = rank[rows], rank[np.minimum(rows + step, n)]
        by = np.lexsort((after, head))
        rows, head, after = rows[by], head[by], after[by]
        order[slots] = rows
        new = np.r_[True, (head[1:] != head[:-1]) | (after[1:] != after[:-1])]
        fresh[slots] = new
        rank[rows] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2


class Bits:
    """A bit sequence with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.total = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Index:
    """Backward search over a sequence of symbols 1..most, with 0 between documents."""

    def __init__(self, symbols: np.ndarray, most: int):
        n = len(symbols)
        ends = symbols == 0
        unique = symbols.astype(np.int64) + int(ends.sum())
        unique[ends] = np.arange(int(ends.sum()))
        order = suffix_order(unique, int(unique.max(initial=1)).bit_length())
        last = symbols[order - 1].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.depth = max(1, int(most).bit_length())
        row = last
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(n - self.levels[-1].total)
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = (order % SAMPLE == 0) | (last == 0)
        self.sampled = Bits(kept)
        self.samples = order[kept]

    def _ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row."""
        begin = np.zeros(len(at), np.int64)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            r_at, r_begin = bits.rank(at), bits.rank(begin)
            at = np.where(one, zeros + r_at, at - r_at)
            begin = np.where(one, zeros + r_begin, begin - r_begin)
        return at - begin

    def _step(self, at: np.ndarray) -> np.ndarray:
        """Row of the suffix that is one symbol longer."""
        symbol = np.zeros(len(at), np.int64)
        begin = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit = bits.get(at)
            symbol = symbol * 2 + bit
            r_at, r_begin = bits.rank(at), bits.rank(begin)
            at = np.where(bit == 1, zeros + r_at, at - r_at)
            begin = np.where(bit == 1, zeros + r_begin, begin - r_begin)
        return self.starts[symbol] + at - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of equally long patterns, one a line; empty where there is none."""
        low = self.starts[patterns[:, -1]]
        high = self.starts[patterns[:, -1] + 1]
        alive = np.flatnonzero(low < high)
        for i in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[alive, i]
            low[alive] = self.starts[symbol] + self._ranks(symbol, low[alive])
            high[alive] = self.starts[symbol] + self._ranks(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        gone = np.ones(len(patterns), bool)
        gone[alive] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        todo, at, walked = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.sampled.get(at) == 1
            out[todo[hit]] = self.samples[self.sampled.rank(at[hit])] + walked
            todo, at = todo[~hit], at[~hit]
            at = self._step(at)
            walked += 1
        return out
