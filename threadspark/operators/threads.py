"""Tree operators over the flat content table: children index, leaves, chains, rejects.

The content table has one row per unit with ``id``, ``parent_id`` and ``is_post``.
A *chain* is the root-to-leaf path of a leaf: walk parent pointers from the leaf
up to the first post. Chains are built by pointer doubling: the joins number
the logarithm of the deepest tree, their lineage is cut with reliable checkpoints,
there is no per-row Python and nothing is collected.

Skew: a single post may own a large share of all rows. Joins on ``parent_id``
and on ancestor ids are plain shuffle joins, which AQE's skew-join splits; the
children index is offered in long form (one row per edge) and as counts
(partially aggregated), while the array form is opt-in because one array per
parent is as large as that parent's fan-out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.session import ensure_checkpoint_dir, materialize, stored


def dedupe_units(units: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` (default: all columns).

    A deterministic stand-in for "first match wins". Implemented as a grouped
    ``min`` over a struct, which is partially aggregated before the shuffle, so
    a key repeated millions of times costs one row per map task.
    """
    cols = [c for c in units.columns if c != key]
    order = [c for c in (order or []) if c in cols]
    rest = [c for c in cols if c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_r")
    best = units.groupBy(key).agg(F.min(packed).alias("_r"))
    return best.select(F.col(key), *[F.col("_r." + c).alias(c) for c in cols]).select(*units.columns)


def children_edges(units: DataFrame) -> DataFrame:
    """T3 (long form): one row per (parent_id, child_id); null parents excluded."""
    return units.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("id").alias("child_id"))


def child_counts(units: DataFrame) -> DataFrame:
    """Number of children per parent id (partial aggregation, skew-safe)."""
    return (
        units.where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.count(F.lit(1)).cast("int").alias("child_count"))
    )


def children_lists(units: DataFrame) -> DataFrame:
    """T3 (array form): parent_id -> sorted ARRAY of child ids.

    One output row holds all children of a parent; use :func:`children_edges`
    where a parent's fan-out is unbounded.
    """
    return (
        units.where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.array_sort(F.collect_list("id")).alias("children_ids"))
    )


def with_children(units: DataFrame, with_ids: bool = False) -> DataFrame:
    """T4: attach ``child_count`` (and optionally ``children_ids``) by left join on id."""
    counts = child_counts(units).withColumnRenamed("parent_id", "_pid")
    out = units.join(counts, units["id"] == counts["_pid"], "left").drop("_pid")
    out = out.withColumn("child_count", F.coalesce(F.col("child_count"), F.lit(0)))
    if with_ids:
        lists = children_lists(units).withColumnRenamed("parent_id", "_pid")
        out = out.join(lists, out["id"] == lists["_pid"], "left").drop("_pid")
        out = out.withColumn("children_ids", F.coalesce(F.col("children_ids"), F.array().cast("array<string>")))
    return out


def leaves(units: DataFrame) -> DataFrame:
    """T5: units that are nobody's parent (anti-join; safe with null parents)."""
    parents = units.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_pid")).distinct()
    return units.join(parents, units["id"] == parents["_pid"], "left_anti")


def with_leaf(units: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``units`` with ``_leaf``: true where no row of ``source`` (default: ``units``) has the id as parent. Only ids meet."""
    parents = (source or units).where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_pid")).distinct()
    return units.join(parents, F.col("id") == F.col("_pid"), "left").withColumn("_leaf", F.col("_pid").isNull()).drop("_pid")


@dataclass(frozen=True)
class Reach:
    """What :func:`reach` found: ``nodes`` (id, root, depth and, if asked for, value) and the jump tables.

    ``jumps[k]`` holds (id, anc) with ``anc`` the ancestor 2**k steps up, for units at least that deep.
    With leaves marked, ``inner`` and ``tips`` are the nodes that are no leaves and those that are.
    """

    nodes: DataFrame
    jumps: list[DataFrame]
    inner: DataFrame | None = None
    tips: DataFrame | None = None


def reach(units: DataFrame, value: Column | None = None, leaf: str | None = None) -> Reach:
    """Every unit reachable from a post, by pointer doubling: log2(depth) + 2 joins at most, however deep the trees are.

    A unit knows an ancestor and the steps to it; each round it takes over the ancestor's own ancestor, so
    the distance doubles, until the ancestor is a post. ``value`` is concatenated from the post down
    to the unit the same way (strings or arrays): it moves once per round, not once per ancestor.
    ``leaf`` names a column that is true for units nobody has as parent: they are left out of the ancestors' side of the
    joins, where most of the text would be theirs, and ``nodes`` keep the column. Their own ``value`` stays out of the rounds
    and meets their parent's once, after the last.
    A round that brings no unit to a post ends the loop: what is left hangs on a cycle or
    a missing parent. Rounds are written with a reliable checkpoint, those with a value as compressed tables; joins
    are on unit ids, and those on a hot ancestor are split by AQE.
    """
    cut = materialize if value is None else stored
    ensure_checkpoint_dir(units.sparkSession)
    more = [] if value is None else ["value"]
    own = [] if leaf is None else [leaf]
    at_post = F.col("is_post")
    base = units.where(at_post | F.col("parent_id").isNotNull()).select(
        "id", F.when(at_post, F.col("id")).otherwise(F.col("parent_id")).alias("anc"), F.when(at_post, 0).otherwise(1).alias("hops"),
        at_post.alias("done"), *([] if value is None else [value.alias("value")]), *own,
    )
    base = cut(base.where(F.col("done").isNotNull()))
    finished, active = [base.where("done")], base.where("NOT done")
    if leaf is not None:
        active = active.select(*[F.when(~F.col(leaf), F.col(c)).alias(c) if c in more else c for c in active.columns])
    jumps = [active.select("id", "anc")]
    while True:
        up = reduce(DataFrame.unionByName, [*finished, active])
        up = (up if leaf is None else up.where(~F.col(leaf))).alias("u")
        new = active.alias("a").join(up, F.col("a.anc") == F.col("u.id")).select(
            "a.id", "u.anc", (F.col("a.hops") + F.col("u.hops")).alias("hops"), "u.done", *[F.concat(f"u.{c}", f"a.{c}").alias(c) for c in more], *[F.col(f"a.{c}") for c in own]
        )
        new = cut(new)
        n_done, n_all = new.agg(F.count_if("done"), F.count(F.lit(1))).first()
        if n_done:
            finished.append(new.where("done"))
        if n_done in (0, n_all):
            break
        active = new.where("NOT done")
        jumps.append(active.select("id", "anc"))
    out = ["id", F.col("anc").alias("root"), F.col("hops").alias("depth"), *more, *own]
    if leaf is None:
        return Reach(reduce(DataFrame.unionByName, finished).select(*out), jumps)
    inner = reduce(DataFrame.unionByName, finished).where(~F.col(leaf))
    tip, up = base.where(F.col(leaf) & ~F.col("done")).alias("a"), inner.alias("u")
    tips = tip.join(up, F.col("a.anc") == F.col("u.id")).select(
        "a.id", "u.anc", (F.col("a.hops") + F.col("u.hops")).alias("hops"), *[F.concat(f"u.{c}", f"a.{c}").alias(c) for c in more], f"a.{leaf}"
    )
    tips = base.where(F.col(leaf) & F.col("done")).select(*tips.columns).unionByName(tips)
    inner, tips = inner.select(*out), tips.select(*out)
    return Reach(inner.unionByName(tips), jumps, inner, tips)


def reach_paths(units: DataFrame) -> DataFrame:
    """Root-to-node path of every unit reachable from a post: ``(id, path ARRAY<STRING>, depth INT)``."""
    return reach(units, F.array("id")).nodes.select("id", F.col("value").alias("path"), "depth")


def chain_members(units: DataFrame, reached: Reach | None = None) -> DataFrame:
    """``(chain_id, chain_rank, id)`` for every chain; chain_id = leaf id, rank 0 = root.

    Starting from each leaf, the rows double with each jump table, largest jump first: a row at some
    distance from the leaf adds the one 2**k further up. No path is held in a row, and the
    rows moved add up to about twice the result.
    """
    reached = reached or reach(units)
    leaf_ids = leaves(units).select(F.col("id").alias("_leaf"))
    rows = reached.nodes.join(leaf_ids, reached.nodes["id"] == leaf_ids["_leaf"], "left_semi").select(
        F.col("id").alias("chain_id"), "depth", F.col("id").alias("node"), F.lit(0).alias("hop")
    )
    for k in reversed(range(len(reached.jumps))):
        jump = reached.jumps[k].select(F.col("id").alias("_from"), "anc")
        both = F.array(F.struct("node", "hop"), F.struct(F.col("anc").alias("node"), (F.col("hop") + 2**k).alias("hop")))
        rows = rows.join(jump, F.col("node") == F.col("_from"), "left").select("chain_id", "depth", F.explode(both).alias("s"))
        rows = rows.where(F.col("s.node").isNotNull()).select("chain_id", "depth", "s.node", "s.hop")
    return rows.select("chain_id", (F.col("depth") - F.col("hop")).cast("int").alias("chain_rank"), F.col("node").alias("id"))


def chain_table(units: DataFrame, with_children_ids: bool = False, reached: Reach | None = None) -> DataFrame:
    """The chain table = unit columns + child_count [+ children_ids] + chain_id + chain_rank.

    ``units`` must already be unique per id (see :func:`dedupe_units`).
    """
    members = chain_members(units, reached)
    enriched = with_children(units, with_ids=with_children_ids)
    out = members.join(enriched, "id")
    extra = (["children_ids"] if with_children_ids else []) + ["child_count", "chain_id", "chain_rank"]
    return out.select(*units.columns, *extra)


def rejects(units: DataFrame, reached: Reach | None = None) -> DataFrame:
    """Units never reached from a post (orphans, cycles, their descendants)."""
    ids = (reached or reach(units)).nodes.select(F.col("id").alias("_rid"))
    return units.join(ids, units["id"] == ids["_rid"], "left_anti")


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate expression: the group's ``value``s as an ARRAY sorted by ``order``."""
    packed = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(packed, lambda s: s["v"])


def ordered_join(order: Column, value: Column, sep: str = "") -> Column:
    """Aggregate expression: the group's ``value``s concatenated in ``order``."""
    return F.array_join(ordered_list(order, value), sep)
