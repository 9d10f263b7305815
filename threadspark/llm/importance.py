"""Target-distribution importance resampling on hashed n-gram features.

Features are all runs of 1 to 3 words; a feature's bucket is the CRC-32 of its bytes modulo the number
of buckets. The log-ratio of the smoothed bucket frequencies of a target text set and of the corpus is a
bucket's gain, a document's weight is the sum over its features, and Gumbel noise
from a hash of its id turns the highest scores into a draw without replacement in proportion to the weights.

CRCs come from length-bucketed matrices: the distinct features of a portion of text are grouped by byte
length into two-dimensional uint8 arrays, one column of bytes per array row, all CRCs of a group are
updated column by column, and the buckets are scattered back to the features' places. A group with fewer than ``FEW``
strings per byte of length (long features, rare lengths) is no matrix worth its columns: its strings go one by
one through zlib's CRC-32, the same function.

Both passes (corpus counts, then weights) read the texts where they lie and shuffle none of them: the first
sends at most one count per bucket and task, the second one narrow row per document. The gains, one number per
bucket, are the only thing on the driver. Ranks come from a range-partitioned numbering of narrow rows.

Edge cases: null or empty texts have no words, features 0 and weight 0; texts of any length are cut into
portions that share two words, so memory stays bounded; equal scores go to the smaller id, equal ids among them
to any order; a null id is hashed as the empty string; repeated rows are drawn each on their own; an empty corpus gives no rows and an
empty target gains from smoothing alone; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import numbered
from threadspark.session import materialize

BUCKETS = 10_000
LONGEST_RUN = 3
PORTION = 1_000_000
FEW = 4

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc_matrix(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of every column of a (length x strings) uint8 array, all strings at once, byte by byte."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def slice_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte slices ``data[start:start + size]``, grouped by size."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    sizes, first = np.unique(size[order], return_index=True)
    for n, group in zip(sizes.tolist(), np.split(order, first[1:])):
        if len(group) < FEW * n:
            out[group] = [zlib.crc32(data[a : a + n].tobytes()) for a in start[group]]
            continue
        rows = max(1, PORTION // max(n, 1))
        for k in range(0, len(group), rows):
            part = group[k : k + rows]
            out[part] = crc_matrix(data[np.arange(n)[:, None] + start[part][None, :]])
    return out


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """The first place of every code."""
    first = np.zeros(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


class Words:
    """Words of some texts side by side: lower-cased bytes, each word followed by one blank."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        """``edges``: where the texts start and the last one ends."""
        data = _LOWER[data]
        inside = _IS_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[edges] = True
        before = np.concatenate(([False], inside[:-1])) & ~cut[:-1] if len(data) else inside
        after = np.concatenate((inside[1:], [False])) & ~cut[1:] if len(data) else inside
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.size = end - start
        self.start = np.cumsum(self.size + 1) - (self.size + 1)
        self.data = np.full(int((self.size + 1).sum()), 32, np.uint8)
        letters = np.ones(len(self.data), bool)
        letters[self.start + self.size] = False
        self.data[letters] = data[inside]
        self.text = np.searchsorted(edges, start, "right") - 1

    def features(self, carried: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per run length: the text and the CRC of every feature whose last word is not among the first ``carried`` words."""
        n = len(self.size)
        offsets = np.append(self.start, len(self.data))
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data)])
        words = held.dictionary_encode().indices.to_numpy().astype(np.int64)
        runs = words
        for k in range(1, LONGEST_RUN + 1):
            if n < k:
                return
            if k > 1:  # the codes of the run one word shorter and of its last word
                runs = pd.factorize(runs[: n - k + 1] * (n + 1) + words[k - 1 :])[0]
            own = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
            own = own[own >= carried - k + 1]
            codes, known = pd.factorize(runs[own])
            at = own[_first(codes, len(known))]
            crc = slice_crcs(self.data, self.start[at], self.start[at + k - 1] + self.size[at + k - 1] - self.start[at])
            yield self.text[own], crc[codes]


def portions(texts: pa.Array) -> Iterator[tuple[int, Words, int]]:
    """(number of the first text, words, words already seen) over all texts; a text over ``PORTION`` bytes comes in pieces."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PORTION, "right")) - 1)
        if offsets[end] - offsets[k] <= PORTION:
            yield k, Words(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]), 0
        else:
            at, carry, carried = int(offsets[k]), np.zeros(0, np.uint8), 0
            while at < offsets[end]:
                stop = min(at + PORTION, int(offsets[end]))
                while stop < offsets[end] and _IS_WORD[_LOWER[data[stop]]]:
                    stop += 1
                piece = np.concatenate((carry, data[at:stop]))
                w = Words(piece, np.array([0, len(piece)]))
                yield k, w, carried
                carried = min(len(w.size), LONGEST_RUN - 1)
                carry = w.data[w.start[-carried] :] if carried else w.data[:0]
                at = stop
        k = end


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: feature occurrences over all ``text``s."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words, carried in portions(batch.column(0)):
                for _, crc in words.features(carried):
                    total += np.bincount(crc % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One gain per bucket, from all documents and all target texts."""
    held = {}
    for name, df in (("corpus", docs), ("target", target)):
        held[name] = [0] * buckets
        for r in bucket_counts(df, buckets).collect():  # one row per bucket
            held[name][r["bucket"]] = r["n"]
    total_s, total_t = sum(held["corpus"]), sum(held["target"])
    gain = lambda s, t: math.floor(1000 * math.log(float((t + 1) * (total_s + buckets)) / float((s + 1) * (total_t + buckets))))
    return np.array([gain(s, t) for s, t in zip(held["corpus"], held["target"])], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gains: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gains)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, words, carried in portions(texts):
                new = np.bincount(words.text[carried:])
                n_words[first : first + len(new)] += new
                for text, crc in words.features(carried):
                    n = np.bincount(text)
                    n_features[first : first + len(n)] += n
                    # whole numbers far below 2**53: exact as doubles
                    weight[first : first + len(n)] += np.bincount(text, gains[crc % buckets]).astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            columns = [ids, *(pa.array(c) for c in (n_words, n_features, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (from 1 among the ``percent`` % drawn, else null)."""
    held = materialize(scored(docs, bucket_gains(docs, target, buckets), seed).withColumn("salt", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    draw = percent * held.where(able).count() // 100
    placed = numbered(held.where(able), [F.col("score").desc(), F.col("doc_id").asc()], "place", "salt")
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank.cast("long").alias("rank")).unionByName(held.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all columns."""
    ids = resample(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")
