"""Sharding of repeated-window searches by content: super-windows around minimal n-gram hashes.

Every window of ``length`` symbols is assigned the smallest hash among the n-grams
it holds. Equal windows get equal anchors wherever they stand, so all occurrences
of a window meet in the shard of its anchor, and neighbouring windows with the same
anchor travel as one segment. The arithmetic is numpy on whole buckets of
documents; hashes are 64 bits and wrap around on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_M = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)]
_CHUNK = 1 << 16
_BASE = U(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


def byte_grams(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of the 24-byte grams starting at a..b (exclusive); data is padded by 24 bytes."""
    words = np.lib.stride_tricks.as_strided(data[a:].view(), shape=(b - a + 16, 8), strides=(1, 1))
    w = np.ascontiguousarray(words).view("<u8").ravel()
    with np.errstate(over="ignore"):
        return mix(w[: b - a] * _M[0] + w[8 : b - a + 8] * _M[1] + w[16 : b - a + 16] * _M[2])


def symbol_grams(symbols: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """Hashes of the n-grams of 64-bit symbols starting at a..b (exclusive)."""
    h = np.zeros(b - a, U)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _M[0] + symbols[a + k : b + k]
    return mix(h)


@dataclass
class Segments:
    """Super-windows: first window start, number of windows, document (position in the bucket), anchor."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray

    def pick(self, which: np.ndarray) -> "Segments":
        return Segments(self.start[which], self.count[which], self.doc[which], self.anchor[which])


def super_windows(grams, ends: np.ndarray, length: int, gram: int) -> Segments:
    """Segments of all windows of ``length`` symbols inside documents ending at ``ends``.

    ``grams(a, b)`` gives the n-gram hashes of positions a to b. A segment holds at most
    ``length - gram + 1`` windows, so it is never longer than two windows.
    """
    total, width = int(ends[-1]) if len(ends) else 0, length - gram + 1
    starts, counts, values = [], [], []
    for a in range(0, max(0, total - length + 1), _CHUNK):
        b = min(a + _CHUNK, total - length + 1)
        low = grams(a, b + width - 1)
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: b - a], low[width - step : width - step + b - a])
        cut = np.zeros(b - a, bool)
        cut[0] = True
        cut[1:] = low[1:] != low[:-1]
        lo, hi = np.searchsorted(ends, [a, b], "right")
        for e in ends[lo : hi + 1].tolist():
            for p in (e, e - length + 1):
                if a <= p < b:
                    cut[p - a] = True
        at = np.flatnonzero(cut)
        starts.append(at + a)
        counts.append(np.diff(np.append(at, b - a)))
        values.append(low[at])
    if not starts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, np.zeros(0, U))
    start, count, value = np.concatenate(starts), np.concatenate(counts), np.concatenate(values)
    if (count > width).any():
        pieces = -(-count // width)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + part * width
        count = np.minimum(width, np.repeat(count, pieces) - part * width)
        value = np.repeat(value, pieces)
    doc = np.searchsorted(ends, start, "right")
    inside = start + count + length - 1 <= ends[doc]
    return Segments(start[inside], count[inside], doc[inside], value[inside])


def shard_key(anchor: np.ndarray, shards: int) -> np.ndarray:
    """(shard << 32 | 32-bit fingerprint) of anchors; the fingerprint only filters."""
    h = mix(anchor)
    return ((h >> U(33)) % U(shards)) << U(32) | (h & U(0xFFFFFFFF))


def strong_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit hashes of the byte ranges a..b, as two columns; these stand for equality, so no polynomial will do."""
    from xxhash import xxh3_128_digest

    view, out = memoryview(data), np.empty((len(a), 2), U)
    for k in range(0, len(a), _CHUNK):  # the digests of a chunk are Python objects
        some = zip(a[k : k + _CHUNK].tolist(), b[k : k + _CHUNK].tolist())
        out[k : k + _CHUNK] = np.frombuffer(b"".join([xxh3_128_digest(view[x:y]) for x, y in some]), U).reshape(-1, 2)
    return out


def prefix_hash(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and inverse powers for ``range_hash``."""
    with np.errstate(over="ignore"):
        power = np.full(len(symbols) + 1, _BASE, U)
        power[0] = 1
        power = np.cumprod(power, dtype=U)
        sums = np.concatenate((np.zeros(1, U), np.cumsum((symbols + U(1)) * power[:-1], dtype=U)))
        inverse = np.full(len(symbols) + 1, U(pow(int(_BASE), -1, 2**64)), U)
        inverse[0] = 1
        return sums, np.cumprod(inverse, dtype=U)


def range_hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the symbol ranges a..b, independent of where they stand; different ranges may share one, so they only choose anchors."""
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U) * _M[1])


def gather(data: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenation of data[a_k : a_k + n_k]."""
    total = np.cumsum(n)
    if not len(n):
        return data[:0]
    return data[np.arange(total[-1]) + np.repeat(a - (total - n), n)]
