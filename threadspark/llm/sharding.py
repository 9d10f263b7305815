"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (DataFrame functions only).

1. Rows fall into blocks by a hash of their id; the blocks are counted.
2. The matrix (rows that block i sends to shard j) is drawn: its block sums are the counts, its shard
   sums the exact shard sizes, its law that of a uniform permutation. Blocks are the leaves of a tree of
   ``WAYS`` branches: each node hands its share of every shard's places to its branches by multivariate hypergeometric
   draws, one after another within a node and all nodes of a level side by side. Blocks number
   between N**0.5 / 4 and 4 * N**0.5, so the matrix stays small beside the rows and no block is large.
3. Every block permutes its rows locally and cuts the order at its matrix row: that names each row's shard.
4. Every shard permutes again: rows fall into parts by a second hash, and a part's order and the rows of
   the parts before it give the slot.

A draw inverts the hypergeometric law exactly to double precision: weights run up and down
from the mode by the ratio of neighbouring terms, as far as a double sees them. All randomness is a hash of
seed and id, so the result is the same on any partitioning and after any lost task.

Edge cases: a null id or an id that several rows carry is told apart by its place in the written input (equal ids then
spread over blocks and shards like any others, and only for those rows does the result depend on the layout); null
and empty texts count as rows; a text's length plays no part; fewer rows than shards leave
shards empty; an empty table gives no rows; the input's columns travel as one struct, so no name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadspark.llm.common import as_rows, shuffle_parts
from threadspark.session import materialize

WAYS = 16


def _number(c: Column) -> Column:
    return c.cast("double")


def _walk(steps: Column, start: Column, step, target: Column | None, begin: Column) -> Column:
    """Sum of weights from ``begin`` on (``found`` < 0), or with ``target`` the first value whose running sum exceeds it.

    ``step(x, w)`` gives the next (value, weight) after value ``x`` of weight ``w``; the first weight is 1 at ``start``.
    """
    zero = F.struct(start.alias("x"), F.lit(1.0).alias("w"), begin.alias("total"), F.lit(-1).cast("long").alias("found"))

    def go(a: Column, _: Column) -> Column:
        x, w = step(a["x"], a["w"])
        total = a["total"] + w
        found = F.lit(-1).cast("long") if target is None else F.when((a["found"] < 0) & (total > target), x).otherwise(a["found"])
        return F.struct(x.alias("x"), w.alias("w"), total.alias("total"), found.alias("found"))

    return F.aggregate(steps, zero, go)


def _let(values: list[Column], body) -> Column:
    """``body(*values)``, each computed once."""
    packed = F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))
    return F.element_at(F.transform(packed, lambda s: body(*[s[f"v{k}"] for k in range(len(values))])), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Good ones among ``draws`` taken from ``total`` of which ``good`` are good; ``u`` uniform in (0, 1)."""
    rest = total - good
    low, high = F.greatest(F.lit(0).cast("long"), draws - rest), F.least(draws, good)
    mode = F.floor((_number(draws) + 1) * (_number(good) + 1) / (_number(total) + 2)).cast("long")
    spread = F.sqrt(_number(draws) * good / total * rest / total * (total - draws) / F.greatest(total - 1, F.lit(1)))
    reach = F.ceil(spread * 9 + 30).cast("long")

    def pick(low, high, mode, reach, good, draws, rest, u):
        up_to, down_to = F.least(high, mode + reach), F.greatest(low, mode - reach)
        count = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
        ups, downs = count(up_to - mode), count(mode - down_to)

        def up(x, w):
            return x + 1, w * (_number(good - x) * _number(draws - x)) / (_number(x + 1) * _number(rest - draws + x + 1))

        def down(x, w):
            return x - 1, w * (_number(x) * _number(rest - draws + x)) / (_number(good - x + 1) * _number(draws - x + 1))

        above = _walk(ups, mode, up, None, F.lit(1.0))["total"]
        every = _walk(downs, mode, down, None, above)["total"]

        def search(above, target):
            high_hit = _walk(ups, mode, up, target, F.lit(1.0))["found"]
            low_hit = _walk(downs, mode, down, target, above)["found"]
            # rounding may leave the very last sum at the target: the outermost value then
            outer = F.when(down_to < mode, down_to).otherwise(up_to)
            return F.when(target < 1, mode).when(target < above, high_hit).otherwise(F.when(low_hit >= 0, low_hit).otherwise(outer))

        return _let([above, u * every], search)

    return F.when(low == high, low).otherwise(_let([low, high, F.greatest(low, F.least(mode, high)), reach, good, draws, rest, u], pick))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _share(left: Column, rows: Column, seed: int, node: Column) -> Column:
    """How many of ``rows`` go to each shard with ``left`` places: one multivariate hypergeometric draw."""
    zero = F.struct(
        F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), rows.alias("rows"), F.array().cast("array<bigint>").alias("out")
    )

    def take(a: Column, good: Column) -> Column:
        x = hypergeometric(a["total"], good, a["rows"], uniform(F.lit(seed), node, F.size(a["out"])))
        return _let([x], lambda x: F.struct((a["total"] - good).alias("total"), (a["rows"] - x).alias("rows"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(left, zero, take, lambda a: a["out"])


def communication_matrix(blocks: DataFrame, levels: int, places: list[int], seed: int) -> DataFrame:
    """block, sends (rows to each shard); ``blocks``: block, n. ``places`` sums to the rows of all blocks."""
    spark = blocks.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(p).cast("long") for p in places]).alias("left"))
    for level in range(1, levels + 1):
        shift = int(math.log2(WAYS)) * (levels - level)
        child = F.shiftright("block", shift)
        sums = blocks.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        own = sums.groupBy(F.shiftright("child", int(math.log2(WAYS))).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("branches"))
        zero = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<child: bigint, sends: array<bigint>>>").alias("out"))

        def hand(a: Column, b: Column) -> Column:
            drawn = _share(a["left"], b["n"], seed, F.lit(level << 40) + b["child"])
            return _let([drawn], lambda d: F.struct(
                F.zip_with(a["left"], d, lambda x, y: x - y).alias("left"),
                F.concat(a["out"], F.array(F.struct(b["child"].alias("child"), d.alias("sends")))).alias("out"),
            ))

        # the draws are work, not bytes: an explicit number of partitions keeps them from being merged into one task
        handed = nodes.join(own, "node").repartition(shuffle_parts(spark), "node").select(F.explode(F.aggregate("branches", zero, hand, lambda a: a["out"])).alias("b"))
        nodes = materialize(handed.select(F.col("b.child").alias("node"), F.col("b.sends").alias("left")))
    return nodes.select(F.col("node").alias("block"), F.col("left").alias("sends"))


def shuffle_rows(rows: DataFrame, id_column: str, shards: int, seed: int = 42) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``), ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (gapless from 0): a uniform shuffle.

    The rows are written out twice and exchanged twice; pass only the columns needed.
    """
    held = materialize(as_rows(rows).withColumns({"id": F.col(f"row.`{id_column}`"), "at_row": F.monotonically_increasing_id()}))
    total = held.count()
    levels = max(1, round(math.log(max(total, 2), WAYS) / 2))
    several = held.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("_id").isNull())
    salt = F.when(F.col("n").isNotNull(), F.col("at_row"))
    keyed = held.join(several, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("key", F.xxhash64(F.lit(seed), F.col("id"), F.coalesce(salt, F.lit(-1).cast("long")))).drop("_id", "n")
    draw = lambda k: F.xxhash64(F.lit(k), F.col("key"))
    block = lambda k: F.pmod(draw(k), F.lit(WAYS**levels).cast("long"))
    keyed = materialize(keyed.withColumn("block", block(1)))

    places = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), levels, places, seed)
    ends = matrix.select("block", F.transform("sends", lambda _, j: F.aggregate(F.slice("sends", F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    tie = ["id", "at_row"]
    local = F.row_number().over(Window.partitionBy("block").orderBy(draw(2), *tie)) - 1
    sent = keyed.withColumn("at", local).join(ends, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    sent = materialize(sent.drop("at", "ends", "block").withColumn("part", block(3)))

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy(draw(4), *tie)) - 1
    return sent.withColumn("at", inner).join(starts, ["shard", "part"]).select("row", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document (law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_rows(narrow, "doc_id", shards, seed).select(
        "row.*", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 42) -> None:
    """Parquet below ``path``/shard=k, each file a run of slots in order: ``row`` (all columns of ``docs``) and ``slot``."""
    done = shuffle_rows(docs, "doc_id", shards, seed)
    parts = shuffle_parts(docs.sparkSession)
    done.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
