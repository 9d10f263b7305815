"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with q distinct five-word shingles is found in a document when at least
t = ceil(0.8 q) of them occur there. Items are partitioned by q; each partition
keeps the q - t + 1 smallest shingle hashes of its items (a bottom-m MinHash
sketch whose length follows from the size). A document holding t of the q
shingles must hold at least one of any q - t + 1 of them, so probing the stream
of document hashes with the sketches loses no pair, however long the document.
Candidates are verified by exact shingle containment on the words themselves.

The sketches are a function of the benchmark alone. They are broadcast only when
counted and found at most ``BROADCAST_ROWS``; beyond that the same join is a
shuffled one. No Python runs on the executors.

Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters,
so changed case, punctuation or white space hides nothing.

Edge cases: null or empty texts have no words; an item of one to four words is one shingle of all
its words, an item without words is never reported; rows with the same item id are pooled by (id, text) and each text is
searched for itself; repeated documents are reported once each per distinct (id, text); empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import as_rows, ascii_lower, let
from threadspark.session import materialize

SHINGLE = 5
THRESHOLD_PERCENT = 80
BROADCAST_ROWS = 500_000

BREAK_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK_RE), lambda w: w != "")


def shingle_hashes(word_array: Column, n: int = SHINGLE) -> Column:
    """64-bit hash of every n-word shingle, in order; empty below n words."""

    def rolled(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    return let(
        F.transform(word_array, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= n, rolled(h)).otherwise(F.array().cast("array<bigint>")),
    )


def shingle_strings(word_array: Column, n: int = SHINGLE) -> Column:
    """Distinct shingles, each framed by spaces."""
    return let(
        word_array,
        lambda w: F.when(
            F.size(w) >= n,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(w, i, n), " "), F.lit(" ")))
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def item_sketches(items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per distinct item text: key, n (words of a shingle: five, or all of a shorter item), shingles, q, need, and its bottom-m sketch of hashes."""
    read = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select(
        "item_id", F.xxhash64("item_id", "text").alias("item_key"), plain_words(F.col("text")).alias("w")
    ).withColumn("n", F.least(F.size("w"), F.lit(SHINGLE))).filter("n > 0")
    by_size = lambda f: F.coalesce(*[F.when(F.col("n") == n, f(F.col("w"), n)) for n in range(1, SHINGLE + 1)])
    base = (
        read.select("item_id", "item_key", "n", by_size(shingle_strings).alias("shingles"), F.array_sort(F.array_distinct(by_size(shingle_hashes))).alias("hashes"))
        .withColumn("q", F.size("shingles"))
        .withColumn("need", F.expr(f"CAST((q * {percent} + 99) DIV 100 AS INT)"))
    )
    return base.withColumn("sketch", F.expr("slice(hashes, 1, q - need + 1)"))


def _contained(docs: DataFrame, items: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """The pairs found, and whether their number is proven small."""
    known = materialize(item_sketches(items, percent))
    probes = known.select("item_key", "n", F.explode("sketch").alias("hash"))
    if (known.agg(F.sum(F.size("sketch"))).first()[0] or 0) <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    sizes = sorted(r["n"] for r in known.select("n").distinct().collect()) or [SHINGLE]  # five values at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    sized = lambda hashes, n: F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash")))
    hashes = let(plain_words(F.col("text")), lambda w: F.flatten(F.array(*[sized(shingle_hashes(w, n), n) for n in sizes])))
    stream = keyed.select("doc_key", F.explode(hashes).alias("s")).select("doc_key", "s.n", "s.hash")
    pairs = materialize(stream.join(probes, ["n", "hash"]).select("doc_key", "item_key").distinct())
    # the texts stay where they are while the candidates, two hashes each, are few; then only candidate texts meet the shingles
    few = pairs.count() <= BROADCAST_ROWS
    normal = F.concat(F.lit(" "), F.array_join(plain_words(F.col("text")), " "), F.lit(" "))
    found = (
        keyed.join(F.broadcast(pairs) if few else pairs, "doc_key")
        .join(known.select("item_id", "item_key", "shingles", "q", "need"), "item_key")
        .select(
            "doc_id", "doc_key", "item_id", "q", "need",
            let(normal, lambda d: F.size(F.filter("shingles", lambda s: F.contains(d, s)))).alias("hit"),
        )
        .filter("hit >= need")
    )
    return found, few


def contained_items(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Pairs with at least ``percent`` % of the item's shingles in the document: doc_id, item_id, n_shingles, n_matched, containment."""
    return _contained(docs, items, percent)[0].select(
        "doc_id", "item_id", F.col("q").cast("long").alias("n_shingles"), F.col("hit").cast("long").alias("n_matched"),
        (F.col("hit") / F.col("q")).alias("containment"),
    ).distinct()


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no benchmark item; a row goes for its own text only, ids are compared null-safe."""
    pairs, few = _contained(docs, items, THRESHOLD_PERCENT)
    found = pairs.select(F.col("doc_id").alias("leaked"), "doc_key").distinct()
    found = F.broadcast(found) if few else found
    held = as_rows(docs).withColumn("own", F.xxhash64("row.doc_id", F.coalesce("row.text", F.lit(""))))
    return held.join(found, F.col("row.doc_id").eqNullSafe(F.col("leaked")) & (F.col("own") == F.col("doc_key")), "left_anti").select("row.*")
