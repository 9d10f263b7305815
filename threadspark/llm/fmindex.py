"""Compressed FM-index: backward search over a wavelet matrix of the transform.

The Burrows-Wheeler transform of a collection of strings is stored as one bitmap per
bit of the alphabet (a wavelet matrix) with ranks every 64 bits; the suffix array is not
kept. Backward search narrows an interval of rows by one symbol; when the match
grows beyond ``length`` symbols the interval is widened to all rows sharing the first
``length``. Each such interval keeps its smallest owner.
"""

from __future__ import annotations

import numpy as np

from threadspark.llm.suffix import suffix_order

U = np.uint64


class BitRanks:
    """A bitmap with rank: ones before position i, for arrays of positions."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, BitRanks, int]] = []
        for shift in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            self.levels.append((shift, BitRanks(bits), int(len(bits) - bits.sum())))
            values = np.concatenate((values[~bits], values[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        begin = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            b, e = bits.rank(begin), bits.rank(i)
            begin, i = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, i - e)
        return i - begin


class FMIndex:
    """Index of strings of integers >= 1; ``ends``: where each ends (exclusive) in ``symbols``, a 0 stands there."""

    #: Bytes indexed at a time.
    portion = 1 << 21

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int):
        self.symbols, self.ends, self.length = symbols, ends, length
        self.left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(len(symbols))
        order, new = suffix_order(symbols, self.left, length)
        self.transform = WaveletMatrix(symbols[order - 1].astype(np.int64))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        self.interval = np.flatnonzero(new)
        self.low_owner = np.minimum.reduceat(owners[np.searchsorted(ends, order)], self.interval)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals after one more symbol to the left; empty when it never stands there."""
        first = self.smaller[symbols]
        return first + self.transform.rank(symbols, low), first + self.transform.rank(symbols, high)

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of a pattern in the collection."""
        low, high = np.array([0]), np.array([len(self.symbols)])
        for c in pattern[::-1]:
            if not 0 < c < len(self.smaller) - 1:
                return 0
            low, high = self.extend(low, high, np.array([c]))
        return int(max(0, high[0] - low[0]))

    def matching(self) -> np.ndarray:
        """Per position: the smallest owner of its ``length``-symbol match; -1 where fewer symbols are left."""
        begins = np.concatenate(([0], self.ends[:-1] + 1))
        sizes = self.ends - begins
        by = np.argsort(-sizes, kind="stable")
        ends, sizes = self.ends[by], sizes[by]
        low, high = np.zeros(len(by), np.int64), np.full(len(by), len(self.symbols), np.int64)
        out = np.full(len(self.symbols), -1, np.int64)
        bounds = np.append(self.interval, len(self.symbols))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))
            at = ends[:live] - 1 - t
            low, high = self.extend(low[:live], high[:live], self.symbols[at])
            if t + 1 >= self.length:
                block = np.searchsorted(self.interval, low, "right") - 1
                low, high = bounds[block], bounds[block + 1]
                out[at] = self.low_owner[block]
        return out
