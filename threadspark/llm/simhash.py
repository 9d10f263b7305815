"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set when over half of the document's shingle
hashes have it. Links (``max_bits`` or fewer differing bits) are found with two
32-bit segments: one segment of a linked pair differs in at most max_bits // 2 bits.
Each distinct fingerprint enters one table per segment and probes it with the
segment's Hamming ball; matches are verified on all 64 bits. Balls only set zero
bits, so of two values that differ by one bit one alone finds the other.

Equal fingerprints are one node, so a group of copies costs one probe. A segment
value shared by more than ``HOT`` different fingerprints is not paired up: probes that
reach it enumerate the ball of the *other* segment instead, whose size is fixed, and
look the full fingerprints up. Every link is found either way.

Edge cases: null or empty texts have fingerprint 0 and link like any other; fewer
words than a shingle give one shingle of the whole sequence; a null id is kept
(component_id is the smallest non-null id reachable, null if there is none); repeated
rows and equal texts share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadspark.llm.common import as_rows
from threadspark.llm.graph import components
from threadspark.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
HOT = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: len(words) - k]]
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): key is a hash of the text, fp a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("t").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, key long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    both = F.array(F.struct(F.lit(0).alias("seg"), low.alias("val")), F.struct(F.lit(1).alias("seg"), high.alias("val")))
    return fps.select("fp", F.explode(both).alias("s")).select("fp", "s.seg", "s.val")


def _ball(bits: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(32), n)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp) -> all pairs (u, v) at ``max_bits`` (0 to 3) or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one cover up to 3 bits")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    table = _segments(fps)
    val, none = F.col("val"), F.lit(None).cast("long")
    flips = [F.when(val.bitwiseAND(F.lit(1 << b)) == 0, val.bitwiseOR(F.lit(1 << b))).otherwise(none) for b in range(32 if max_bits > 1 else 0)]
    probes = table.select(F.col("fp").alias("a"), "seg", F.posexplode(F.array(val, *flips)).alias("flip", "val")).filter("val IS NOT NULL")
    crowded = materialize(table.groupBy("seg", "val").count().filter(F.col("count") > hot).select("seg", "val"))
    some_hot = not crowded.isEmpty()
    cold = table.join(crowded, ["seg", "val"], "left_anti") if some_hot else table
    pairs = (
        probes.join(cold.select("seg", "val", F.col("fp").alias("b")), ["seg", "val"])
        .filter(((F.col("flip") > 0) | (F.col("a") < F.col("b"))) & near(F.col("a"), F.col("b")))
        .select("a", "b")
    )
    if some_hot:
        reach = probes.join(crowded, ["seg", "val"])
        whole = F.when(F.col("seg") == 0, F.col("a").bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(F.col("val"))).otherwise(
            F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft("val", 32))
        )
        for flipped, radius in ((False, max_bits), (True, max_bits - 1)):
            if radius < 0:
                continue
            masks = F.array(*[F.lit(m) for m in _ball(radius)]).cast("array<bigint>")
            shift = F.when(F.col("seg") == 0, F.shiftleft("mask", 32)).otherwise(F.col("mask"))
            asked = (
                reach.filter((F.col("flip") > 0) == F.lit(flipped))
                .select("a", "seg", whole.alias("w"), F.explode(masks).alias("mask"))
                .select("a", F.col("w").bitwiseXOR(shift).alias("b"))
            )
            pairs = pairs.union(asked.join(fps.select(F.col("fp").alias("b")), "b").filter(near(F.col("a"), F.col("b")) & (F.col("a") != F.col("b"))).select("a", "b"))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT
) -> DataFrame:
    """One row per document: doc_id, key (hash of the text), fp (signed long), n_links (different linked fingerprints), root (names the component), component_id."""
    own = materialize(fingerprints(docs, id_col, text, shingle))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    pairs = materialize(links(nodes.select("fp"), max_bits, hot))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    root = components(pairs)
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "root").join(degree, "fp", "left").select("fp", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root", "component_id")
    return own.join(classes, "fp").select("doc_id", "key", "fp", "n_links", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents (all columns) that represent their component: the smallest doc_id stays.

    Each row follows the component of its own text, also when its id is repeated with other texts.
    Of several rows of a component with that same id the one with the smallest text stays. Documents without an
    id only stay when their component has no id at all, again one row.
    """
    found = near_duplicates(docs, "doc_id", "text", shingle, max_bits)
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stay"), "key", "root").distinct()
    order = Window.partitionBy("stay", "root").orderBy("row.text")
    rows = as_rows(docs).withColumn("own", F.xxhash64("row.text"))
    held = rows.join(stay, (F.col("row.doc_id") == F.col("stay")) & (F.col("own") == F.col("key")))
    kept = held.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*")
    if docs.filter("doc_id IS NULL").isEmpty():
        return kept
    rows = materialize(as_rows(docs).filter("row.doc_id IS NULL").withColumn("no", F.monotonically_increasing_id()))
    marked = near_duplicates(rows.select("no", "row.text"), "no", "text", shingle, max_bits)
    known = fingerprints(docs.filter("doc_id IS NOT NULL"), shingle=shingle).select("fp").distinct()
    free = nearest_known(marked, known, max_bits).select(F.col("no").alias("free"))
    return kept.unionByName(rows.join(free, F.col("no") == F.col("free"), "left_semi").select("row.*"))


def nearest_known(marked: DataFrame, known: DataFrame, max_bits: int) -> DataFrame:
    """Representatives (no) of components of rows without id that reach no document with one."""
    fps = marked.select("fp").union(known).distinct()
    root = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    name = lambda d: d.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    free = name(marked.select("doc_id", "fp")).join(name(known).select("root").distinct(), "root", "left_anti")
    return free.groupBy("root").agg(F.min("doc_id").alias("no")).select("no")
