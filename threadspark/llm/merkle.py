"""Merkle manifest of a dataset: bitmap ranks place the leaves, keyed slot arrays reduce the levels.

Every row is a leaf, the hash of its fields. Leaves of one group (a language) ascend by id, and every
``FANOUT`` consecutive nodes become one node until one is left, the group's subroot; the
subroots, ordered by group, form a tree of the same kind.

Places without sorting the leaves: per group, 64-bit words say which ids exist (partial
bit-or aggregation merges them; empty words are never stored, so sparse ids cost
one word each and dense ones a bit), and a popcount directory, a running total over the words,
turns (word, bit) into a leaf's place. One join on (group, word) gives every leaf its slot.

Levels: nodes are grouped by (group, slot div 512) into a slot array of at most 512 digests,
three levels at once; a round keeps 1/512 of the nodes. The way down hands every
array the siblings above it, so a leaf's proof is its own array's siblings and those. No step holds more
than 512 nodes of a tree in a row, however large a group is.

Edge cases: a null field counts as ``-``; a null id comes first in its group and a null group first among the
groups; repeated ids ascend by leaf digest among themselves (a range-partitioned numbering of those rows
alone), so repeated rows are leaves side by side and any order among them gives the same tree; an
empty or very long text is hashed like any other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import ascii_lower, numbered, running_total
from threadspark.session import materialize

FANOUT = 8
LEVELS = 3  # of one round
SPAN = FANOUT**LEVELS

PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as UTF-8 byte count, colon, value; null as a dash."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, id, leaf, ...) with ``slot`` (from 0 within the group) and ``n``, the group's leaves.

    ``leaves`` is read several times and should be materialised.
    """
    word = F.shiftright(F.col("id"), 6)
    words = materialize(
        leaves.groupBy("grp", word.alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits"), F.count(F.lit(1)).alias("held"))
    )
    placed = running_total(words, ["grp", "word"], "held", "upto")
    groups = placed.groupBy(F.col("grp").alias("_g")).agg(F.min("upto").alias("start"), F.sum("held").alias("n"))
    directory = placed.join(groups, F.col("grp").eqNullSafe(F.col("_g"))).select(
        "grp", "word", "bits", "n", (F.col("upto") - F.col("start")).alias("base"),
        (F.col("held") != F.coalesce(F.bit_count("bits"), F.lit(0))).alias("repeats"),
    )
    own = leaves.withColumn("word", word).alias("l")
    d = directory.alias("d")
    held = own.join(d, F.col("l.grp").eqNullSafe(F.col("d.grp")) & F.col("l.word").eqNullSafe(F.col("d.word"))).select("l.*", "d.bits", "d.n", "d.base", "d.repeats")
    below = F.expr("CASE WHEN id & 63 = 0 THEN 0 ELSE bit_count(shiftleft(bits, CAST(64 - (id & 63) AS INT))) END")
    single = held.where(~F.col("repeats")).withColumn("slot", F.col("base") + below)
    several = numbered(held.where("repeats"), ["grp", "id", "leaf"], "number", "salt")
    firsts = several.groupBy("grp", "word").agg(F.min("number").alias("first")).alias("f")
    s = several.alias("s")
    many = s.join(firsts, F.col("s.grp").eqNullSafe(F.col("f.grp")) & F.col("s.word").eqNullSafe(F.col("f.word"))).select(
        "s.*", (F.col("s.base") + F.col("s.number") - F.col("f.first")).alias("slot")
    )
    columns = [*leaves.columns, "slot", "n"]
    return single.select(columns).unionByName(many.select(columns))


def _above(nodes: Column) -> Column:
    """The next level of a slot array."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), "")))


def _siblings(nodes: Column, at: Column) -> Column:
    """The digests before and after place ``at`` in its run."""
    run = F.floor(at / FANOUT).cast("int") * FANOUT
    glue = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
    return F.struct(glue(run + 1, at - run).alias("before"), glue(at + 2, run + FANOUT - 1 - at).alias("after"))


def _tall(n: Column) -> Column:
    """Levels of a tree of ``n`` leaves: the smallest L with FANOUT ** L >= n."""
    return reduce(lambda a, k: a + F.when(n > FANOUT**k, 1).otherwise(0), range(20), F.lit(0))


def rounds_up(nodes: DataFrame) -> list[DataFrame]:
    """Slot arrays of every round, leaves first: grp, part (slot div 512), todo (levels above), loads, levels, top.

    ``nodes``: grp, slot, node, n and ``load``, handed through unchanged. ``levels`` holds the array of
    each level of the round but the top one. The last round has one array per group, whose top is the group's root.
    """
    tallest = nodes.agg(F.max(_tall(F.col("n")))).first()[0] or 0
    at = nodes.select("grp", "slot", "node", _tall(F.col("n")).alias("todo"), "load")
    out = []
    for _ in range(max(1, -(-tallest // LEVELS))):
        arrays = at.groupBy("grp", F.floor(F.col("slot") / SPAN).alias("part"), "todo").agg(
            F.array_sort(F.collect_list(F.struct("slot", "node", "load")), lambda a, b: (a["slot"] - b["slot"]).cast("int")).alias("own")
        )
        arrays = arrays.withColumn("a0", F.transform("own", lambda s: s["node"]))
        for k in range(LEVELS):
            arrays = arrays.withColumn(f"a{k + 1}", F.when(F.col("todo") > k, _above(F.col(f"a{k}"))).otherwise(F.col(f"a{k}")))
        arrays = materialize(
            arrays.select(
                "grp", "part", "todo", F.transform("own", lambda s: s["load"]).alias("loads"),
                F.array(*[F.col(f"a{k}") for k in range(LEVELS)]).alias("levels"), F.element_at(f"a{LEVELS}", 1).alias("top"),
            )
        )
        out.append(arrays)
        at = arrays.select(
            "grp", F.col("part").alias("slot"), F.col("top").alias("node"), F.greatest(F.col("todo") - LEVELS, F.lit(0)).alias("todo"), F.lit(None).cast("int").alias("load")
        )
    return out


def paths_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """grp, slot, node, load, path of every leaf and the columns of ``tops``: grp, path (above each group's root) and others of one value a group."""
    t = tops.withColumnsRenamed({"grp": "_g", "path": "up"})
    more = [c for c in tops.columns if c not in ("grp", "path")]
    below = None
    for k in reversed(range(len(rounds))):
        meets = F.col("grp").eqNullSafe(F.col("_g"))
        if below is not None:
            t = below.select(F.col("grp").alias("_g"), F.col("slot").alias("_s"), F.col("path").alias("up"), *more)
            meets = meets & (F.col("part") == F.col("_s"))
        held = rounds[k].join(t, meets)

        def place(node: Column, at: Column) -> Column:
            local = F.array(*[F.when(F.col("todo") > j, _siblings(F.get("levels", F.lit(j)), F.floor(at / FANOUT**j).cast("int"))) for j in range(LEVELS)])
            return F.struct(at.alias("at"), node.alias("node"), F.get("loads", at).alias("load"), F.filter(local, lambda s: s.isNotNull()).alias("local"))

        # siblings first, then one row per node: the arrays are not copied into each row
        each = held.select("grp", "part", "up", *more, F.explode(F.transform(F.get("levels", F.lit(0)), place)).alias("e"))
        below = each.select("grp", (F.col("part") * SPAN + F.col("e.at")).alias("slot"), "e.node", "e.load", F.concat("e.local", "up").alias("path"), *more)
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def manifest(docs: DataFrame, id_column: str, group_column: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, grp, slot, leaf, changed (leaf after ``tampered`` replaced some fields), subroot, root, path (siblings to the root)."""
    tampered = tampered or {}
    leaves = materialize(
        docs.select(
            F.col(id_column).cast("long").alias("id"), F.col(group_column).alias("grp"),
            leaf_digest(*[F.col(c) for c in fields]).alias("leaf"),
            leaf_digest(*[tampered.get(c, F.col(c)) for c in fields]).alias("changed"),
            F.monotonically_increasing_id().alias("salt"),
        )
    )
    placed = leaf_places(leaves).select("grp", "slot", F.col("leaf").alias("node"), "n", F.struct("id", F.when(F.col("changed") != F.col("leaf"), F.col("changed")).alias("changed")).alias("load"))
    trees = rounds_up(materialize(placed))
    subroots = trees[-1].select("grp", F.col("top").alias("subroot"))
    groups = numbered(subroots, ["grp"], "slot")
    total = groups.count()
    upper = rounds_up(groups.select(F.lit(0).alias("grp"), "slot", F.col("subroot").alias("node"), F.lit(total).cast("long").alias("n"), F.struct("grp", "subroot").alias("load")))
    ends = upper[-1].select("grp", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    tops = paths_down(upper, ends).select("load.grp", "path", "load.subroot", "root")
    return paths_down(trees, tops).select(
        "load.id", "grp", "slot", F.col("node").alias("leaf"), F.coalesce("load.changed", "node").alias("changed"), "subroot", "root", "path"
    )


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, checked after every third row's text was lower-cased (A-Z)."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0  # a null id is left alone
    m = manifest(
        docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"],
        {"text": F.when(picked, ascii_lower(F.col("text"))).otherwise(F.col("text"))},
    )
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    held = m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))
