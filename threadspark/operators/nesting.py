"""Nested thread documents <-> flat content rows.

A thread document is one JSON object per post whose ``replies`` array holds
the comment objects, recursively. Spark has no recursive struct type, so the
documents are parsed to ``VARIANT`` and flattened one tree level per step
(``variant_get(..., '$.replies', 'array<variant>')`` + ``posexplode``); each
row keeps ``path`` (ordinals from the root), so ordering by
``(thread, path)`` is the pre-order of the tree. Null replies are dropped at
every level, and every unit that is no content unit is kept with its reason. Nesting is the
inverse: each unit becomes a fragment of the document, in pre-order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.schemas import CONTENT_FIELDS, REQUIRED_FIELDS
from threadspark.session import ensure_checkpoint_dir, materialize


def _fields(v: Column) -> list[Column]:
    return [F.try_variant_get(v, f"$.{name}", dtype.simpleString()).alias(name) for name, dtype in CONTENT_FIELDS]


def _reason(v: Column) -> Column:
    """Why a value is no content unit; null when it is one."""
    bad = F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not a document"))

    def present(name: str) -> Column:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        return value.isNotNull() & ~F.is_variant_null(value)

    for name in REQUIRED_FIELDS:
        bad = bad.when(~present(name), F.lit(f"missing {name}"))
    for name, kind in [*((n, t.simpleString()) for n, t in CONTENT_FIELDS), ("replies", "array<variant>")]:
        bad = bad.when(present(name) & F.try_variant_get(v, f"$.{name}", kind).isNull(), F.lit(f"ill-typed {name}"))
    return bad


def load_threads(docs: DataFrame, json_col: str = "value", key_col: str = "thread") -> DataFrame:
    """Every unit of every document, good and bad: content columns, ``thread``, ``path`` and ``reason``.

    ``reason`` is null for a unit; else it says why the row is rejected: ``missing document`` and ``not JSON`` (one
    row with an empty path), ``not a document``, ``missing <field>``, ``ill-typed <field>`` or
    ``below a rejected unit``, as a rejected unit takes its replies along. Nulls in replies are no units. So units and
    rejects add up to what the documents hold.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    parsed = docs.select(F.col(key_col).alias("thread"), F.col(json_col).isNull().alias("_none"), F.try_parse_json(F.col(json_col)).alias("_v"),
                         F.array().cast("array<int>").alias("path"), F.lit(False).alias("_below"))
    level = parsed.select("thread", "_v", "path", "_below", F.when(F.col("_none"), F.lit("missing document")).when(F.col("_v").isNull(), F.lit("not JSON")).alias("_bad"))
    out = []
    while True:  # one round per tree level, until a level is empty
        reason = F.coalesce("_bad", _reason(F.col("_v")), F.when(F.col("_below"), F.lit("below a rejected unit")))
        level = materialize(level.select("thread", "path", "_v", reason.alias("reason")))
        if out and level.isEmpty():
            break
        out.append(level.select("thread", "path", *_fields(F.col("_v")), "reason"))
        kids = level.where(F.col("_v").isNotNull()).select(
            "thread", "path", F.col("reason").isNotNull().alias("_below"),
            F.posexplode(F.try_variant_get("_v", "$.replies", "array<variant>")).alias("_i", "_c"),
        )
        level = kids.where(F.col("_c").isNotNull() & ~F.is_variant_null("_c")).select(
            "thread", F.array_append("path", F.col("_i").cast("int")).alias("path"), F.col("_c").alias("_v"), "_below", F.lit(None).cast("string").alias("_bad")
        )
    return reduce(DataFrame.unionByName, out)


def flatten_threads(docs: DataFrame, json_col: str = "value", key_col: str = "thread",
                    validate: bool = True) -> DataFrame:
    """One row per unit (content columns + ``thread``, ``path``), nulls in replies dropped.

    ``docs`` holds one JSON document per row in ``json_col`` and a thread key in
    ``key_col``. With ``validate`` only accepted units stay (:func:`load_threads` gives the rejects beside them);
    without, ill-typed fields are null and every object of a document that is JSON stays.
    """
    loaded = load_threads(docs, json_col, key_col)
    if validate:
        return loaded.where(F.col("reason").isNull()).drop("reason")
    return loaded.where(~F.coalesce("reason", F.lit("")).isin("missing document", "not JSON")).drop("reason")


def _valid() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED_FIELDS])


def invalid_units(flat: DataFrame) -> DataFrame:
    """Rows of an unvalidated flatten that miss a required field."""
    return flat.where(~_valid())


def unreadable_documents(docs: DataFrame, json_col: str = "value", key_col: str = "thread") -> DataFrame:
    """Rejects of the load: ``(thread, reason)`` of documents that are null or not JSON."""
    bad = docs.where(F.try_parse_json(F.col(json_col)).isNull())
    reason = F.when(F.col(json_col).isNull(), F.lit("missing document")).otherwise(F.lit("not JSON"))
    return bad.select(F.col(key_col).alias("thread"), reason.alias("reason"))


def nest_fragments(units: DataFrame, order_col: str | None = None) -> DataFrame:
    """T2 as rows: ``(thread, path, fragment)``; the fragments of a thread in ``path`` order are its JSON document.

    A unit's fragment opens it (a comma unless it is its parent's first child, its fields, an open list of
    replies) and, when it has no child, closes it and every ancestor that ends there: as many as the
    path's trailing units are last children. Both are known from the row alone, so no document and no
    subtree is ever held in a row and a thread of any size is as many rows as it has units.

    Children are ordered by ``order_col`` (default: id). ``units`` must be unique per id;
    units not reachable from a post are left out.
    """
    from threadspark.operators.threads import reach

    place = F.struct(F.col(order_col if order_col else "id").alias("ord"), F.col("id").alias("id"))
    kids = units.where(~F.col("is_post") & F.col("parent_id").isNotNull())
    ends = kids.groupBy(F.col("parent_id").alias("_pid")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    placed = units.select("*", place.alias("_place"))
    held = placed.join(ends, placed["parent_id"] == ends["_pid"], "left").select(
        placed["*"], (F.col("_place") == F.col("_first")).alias("_is_first"), (F.col("_place") == F.col("_last")).alias("_is_last")
    )
    step = F.struct("_place", F.when(F.col("is_post"), F.lit(True)).otherwise(F.col("_is_last")).alias("last"))
    nodes = reach(held, F.array(step)).nodes.select(F.col("id").alias("_nid"), "root", "depth", "value")
    parents = ends.select(F.col("_pid").alias("_has"))
    rows = held.join(nodes, held["id"] == nodes["_nid"]).join(parents, held["id"] == parents["_has"], "left")

    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    up = F.aggregate(
        F.reverse("value"), zero,
        lambda a, s: F.struct((a["n"] + F.when(a["open"], 1).otherwise(0)).alias("n"), (a["open"] & s["last"]).alias("open")), lambda a: a["n"],
    )
    close = F.when(F.col("_has").isNull(), F.expr("repeat(']}', _close)")).otherwise(F.lit(""))
    comma = F.when(~F.col("is_post") & ~F.col("_is_first"), F.lit(",")).otherwise(F.lit(""))
    own = F.to_json(F.struct(*[F.col(n) for n, _ in CONTENT_FIELDS]), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"_own": own, "_close": up})
    fragment = F.concat(comma, F.expr("substring(_own, 1, length(_own) - 1)"), F.lit(',"replies":['), close)
    return rows.select(F.col("root").alias("thread"), F.transform("value", lambda s: s["_place"]).alias("path"), fragment.alias("fragment"))


def nest_threads(units: DataFrame, order_col: str | None = None) -> DataFrame:
    """``(id, json)`` -- one nested document per post (the inverse of :func:`flatten_threads`), the joined :func:`nest_fragments`.

    A document is one row here by definition; write large threads from the fragments (``writers.write_thread_documents(fmt="files")``).
    """
    parts = nest_fragments(units, order_col).groupBy(F.col("thread").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "fragment"))).alias("parts"))
    return parts.select("id", F.array_join(F.transform("parts", lambda p: p["fragment"]), "").alias("json"))
