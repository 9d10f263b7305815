"""Suffix order of a collection of short strings, by prefix doubling on packed integers."""

from __future__ import annotations

import numpy as np

U = np.uint64


def _order(first: np.ndarray, second: np.ndarray, bits: int, first_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of (first, second) pairs and whether each sorted pair differs from the one before."""
    n = len(first)
    index_bits = max(1, int(n - 1).bit_length())
    if first_bits + bits + index_bits <= 64:
        packed = first.astype(U) << U(bits + index_bits) | second.astype(U) << U(index_bits) | np.arange(n, dtype=U)
        packed.sort()
        order = (packed & U((1 << index_bits) - 1)).astype(np.int64)
        key = packed >> U(index_bits)
    else:
        pair = first.astype(U) << U(bits) | second.astype(U)
        order = np.argsort(pair, kind="stable")
        key = pair[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def suffix_order(symbols: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of strings that each end in symbol 0, and the starts of equal ``length``-prefixes.

    ``symbols``: dense non-negative integers, 0 only as terminator; ``left``: symbols before the
    string's terminator at each position. Equal suffixes of different strings keep the
    order of the text. Returns the suffix array and a flag per row: it does not share
    its first ``length`` symbols with the row above (always set where the suffix is shorter).
    """
    n = len(symbols)
    index_bits = max(1, int(n - 1).bit_length())
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    longest = int(left.max(initial=0)) + 1
    rank, h = symbols.astype(np.int64), 1
    while h < min(length, longest) and (h + 1) * bits + index_bits <= 64:  # fold symbols before the first sort
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= h)
        ahead[inside] = symbols[inside + h]
        rank = rank << bits | ahead
        h += 1
    order, new = _order(rank, np.zeros(n, np.int64), 0, h * bits)
    kept = None
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if h <= length:
            kept = (rank, h)
        if h >= longest:
            break
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= h)
        ahead[inside] = rank[inside + h] + 1
        order, new = _order(rank, ahead, int(n).bit_length(), int(n).bit_length())
        h *= 2
    rank, h = kept
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    long = (left[a] >= length) & (left[b] >= length)
    a, b = a[long], b[long]
    same[1:][long] = (rank[a] == rank[b]) & (rank[a + length - h] == rank[b + length - h])
    return order, ~same
