"""Run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

The transform of a collection of strings is kept as runs: first row, symbol, row of
the run's first symbol in the next step (last-to-first mapping), and the text position
sampled at the run's end. A backward step from a row needs only its run, found by rank
in the bitmap of run heads. Rows that share their first ``length`` symbols form one
interval; each interval keeps its smallest owner.

``matching`` streams the strings backward through the index, all at once: a string's
row after reading position i is the row of its suffix at i, and its match of ``length``
symbols there is the interval around that row.
"""

from __future__ import annotations

import numpy as np

from threadspark.llm.fmindex import BitRanks
from threadspark.llm.suffix import suffix_order


class RunLengthIndex:
    """Index of strings of integers >= 1; ``ends``: where each ends (exclusive) in ``symbols``, a 0 stands there."""

    #: Symbols indexed at a time: a portion's arrays fit a core's cache.
    portion = 1 << 17

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int):
        self.symbols, self.ends, self.length = symbols, ends, length
        left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(len(symbols))
        order, new = suffix_order(symbols, left, length)
        self.left = left
        last = symbols[order - 1]
        starts_run = np.concatenate(([True], last[1:] != last[:-1]))
        self.head, self.runs = np.flatnonzero(starts_run), BitRanks(starts_run)
        self.run_symbol = last[self.head]
        size = np.diff(np.append(self.head, len(last)))
        by = np.argsort(self.run_symbol, kind="stable")
        self.step = np.empty(len(size), np.int64)
        self.step[by] = np.cumsum(size[by]) - size[by]
        self.run_end_sample = order[self.head + size - 1]
        self.intervals = BitRanks(new)
        string = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([-1], ends))))
        self.low_owner = np.minimum.reduceat(owners[string[order]], np.flatnonzero(new))

    def backward(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Rows after reading one more symbol to the left of each row's suffix."""
        run = self.runs.rank(rows + 1) - 1
        if (self.run_symbol[run] != symbols).any():
            raise ValueError("the stream left the indexed text")
        return self.step[run] + rows - self.head[run]

    def matching(self) -> np.ndarray:
        """Per position: the smallest owner of its ``length``-symbol match; -1 where fewer symbols are left."""
        begins = np.concatenate(([0], self.ends[:-1] + 1))
        sizes = self.ends - begins
        by = np.argsort(-sizes, kind="stable")
        rows, ends, sizes = by.copy(), self.ends[by], sizes[by]
        row_at = np.zeros(len(self.symbols), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))
            at = ends[:live] - 1 - t
            rows = self.backward(rows[:live], self.symbols[at])
            row_at[at] = rows
        out = np.full(len(self.symbols), -1, np.int64)
        whole = np.flatnonzero(self.left >= self.length)
        out[whole] = self.low_owner[self.intervals.rank(row_at[whole] + 1) - 1]
        return out
