"""Token ids in directly addressable codes, written as files and read back.

An id is split into ``WIDTH``-bit chunks. Level 0 holds the lowest chunk of every
token and a bitmap telling which tokens go on; level 1 holds the next chunk of only
those, and so on. A rank directory (ones before every 512 bits of a bitmap) turns a
token's place on one level into its place on the next, so any token, or any run of them, is
read without decoding what stands before it.

File format: Parquet rows, one per block of consecutive documents, in ascending
(doc_id, text) order over part files and rows: part (number), base (ids of the
part before the block), doc_ids, doc_ends (tokens up to each document's end, within the
block), n_tokens, and per level its chunks, bitmap and directory. Documents are
range-partitioned by id and encoded where they land; every part knows its own
offsets, and one total per part (as many as shuffle partitions) is all the driver adds up.

Edge cases: null or empty texts have only the end id; null ids come first; equal ids follow by
text; repeated rows are stored each; very long texts stay one document in one block;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm.common import shuffle_parts
from threadspark.llm.encoder import encoder
from threadspark.session import ensure_checkpoint_dir

WIDTH = 8
RANK_STEP = 512
BLOCK_BYTES = 4_000_000
END_ID = 0

_LEVEL = pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
SCHEMA = (
    "part int, base long, n_tokens long, doc_ids array<long>, doc_ends array<long>, "
    "levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
)


def build_levels(ids: np.ndarray) -> list[dict]:
    """Chunk levels of a block of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >= (1 << WIDTH)
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "bitmap": bitmap.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> WIDTH
    return levels


class Codes:
    """Random access to a block's ids."""

    def __init__(self, levels: list[dict]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["bitmap"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bitmap, ranks = self.levels[level]
        block = min(i // RANK_STEP, len(ranks) - 1)
        bits = np.unpackbits(bitmap[block * RANK_STEP // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * RANK_STEP].sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(level, i), shift + WIDTH
        return value

    def run(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive); reads only their chunks."""
        return self._run(0, a, b) if b > a else np.zeros(0, np.uint32)

    def _run(self, level: int, a: int, b: int) -> np.ndarray:
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        more = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            first = self._rank(level, a)
            out[more] |= self._run(level + 1, first, first + int(more.sum())) << np.uint32(WIDTH)
        return out


def _batches(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text; a longer text alone is its own slice."""
    from pyarrow import compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def write_tokens(docs: DataFrame, path: str, vocabulary: str, mode: str = "byte", id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encode all documents and write the token files under ``path``."""
    n = parts or 2 * shuffle_parts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary, mode)
        for batch in batches:
            for piece in _batches(batch, "t", BLOCK_BYTES):
                ids, ends = enc.encode(piece.column("t"))
                with_end = np.insert(ids, ends, END_ID)
                doc_ends = ends + np.arange(1, len(ends) + 1)
                row = [[part], [base], [len(with_end)], [piece.column("doc_id").to_pylist()], [doc_ends.tolist()], [build_levels(with_end)]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(_LEVEL)]
                base += len(with_end)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "base", "n_tokens", "doc_ids", "doc_ends", "levels"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"))
    base.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "t").mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, or (doc_id, start, ids binary) without ``digest``."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per part
    offset, done = {}, 0
    for p in sorted(totals):
        offset[p], done = done, done + totals[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, first = Codes(row["levels"]), offset[row["part"]] + row["base"]
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                raw = [codes.run(a, b).astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + starts, pa.int64())]
                if digest:
                    cols += [pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                else:
                    cols.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] if digest else ["doc_id", "start", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
