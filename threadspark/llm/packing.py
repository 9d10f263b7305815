"""Best-fit-decreasing packing of documents into fixed-length token sequences.

Lengths are integers up to the capacity, so the whole packing problem is a histogram
of at most ``capacity`` counts, whatever the corpus. Best-fit decreasing runs on that
histogram: a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and bins that are alike (same remaining room) are handled as one
range of sequence numbers. The result is a short list of ranges: pieces number a to b
of length l go to sequences s, s + 1, ... at a given offset.

Pieces get their number within their length from one count per (part, length) and
the place within the part, so equally long documents, however many, are never
gathered. Piece rows (numbers only) are checkpointed; the texts are read once and never shuffled.

Edge cases: null or empty texts are one piece holding only the end id; documents longer
than the capacity are cut into full pieces and a rest; repeated rows and null ids are packed each;
ties (equal lengths) go by part and place; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadspark.llm.encoder import encoder
from threadspark.llm.tokencodes import BLOCK_BYTES, END_ID, _batches
from threadspark.session import materialize

CAPACITY = 2048


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, open_: bool) -> None:
        k = room + self.size
        self.any[k] = open_
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest room >= need with an open bin."""
        k = need + self.size
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first piece, per bin, first sequence, offset) and the number of sequences.

    Piece ``r`` of a length, counted from the range's first piece, goes to sequence
    first + r // per_bin, at offset + length * (r % per_bin).
    """
    tree, open_, plan, made = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            open_.setdefault(room, deque()).append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, made, -(-left // (capacity // length))
                made += count
            else:
                first, count = open_[room].popleft()
                if not open_[room]:
                    del open_[room]
                    tree.set(room, False)
            per = room // length
            full = min(count, left // per)
            used = full * per
            if full:
                plan.append((length, done, per, first, capacity - room))
                put(room - per * length, first, full)
            rest = left - used if full < count else 0
            rest = min(rest, per - 1) if rest else 0
            if rest:
                plan.append((length, done + used, per, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), count - full - (rest > 0))
            done, left = done + used + rest, left - used - rest
    return plan, made


def token_pieces(docs: DataFrame, vocabulary: str, mode: str = "word", capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, part, place (within part and length), ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, places, enc = TaskContext.get().partitionId(), Counter(), encoder(vocabulary, mode)
        for batch in batches:
            for sub in _batches(batch, "t", BLOCK_BYTES):
                ids, ends = enc.encode(sub.column("t"))
                raw, at, rows = ids.astype("<u4").tobytes(), 0, []
                for doc, end in zip(sub.column("doc_id").to_pylist(), ends.tolist()):
                    own = raw[4 * at : 4 * end] + END_ID.to_bytes(4, "little")
                    at = end
                    for k, a in enumerate(range(0, len(own), 4 * capacity)):
                        cut = own[a : a + 4 * capacity]
                        n = len(cut) // 4
                        rows.append((doc, k, a // 4, n, zlib.crc32(cut), part, places[n], *([cut] if with_ids else [])))
                        places[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with length, part and place (see ``token_pieces``)."""
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, *rest in sorted(plan):
        by_length.setdefault(length, []).append(tuple(rest))
    firsts = {k: [x[0] for x in v] for k, v in by_length.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place")).drop("base", "part", "place")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                first, per, sequence, offset = by_length[length][bisect_right(firsts[length], rank) - 1]
                seq.append(sequence + (rank - first) // per)
                off.append(offset + length * ((rank - first) % per))
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(run, ", ".join(fields) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, mode: str = "word", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(materialize(token_pieces(docs, vocabulary, mode, capacity, with_ids=with_ids)), capacity)
