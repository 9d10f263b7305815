"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadspark.session import materialize

#: White space of the word definition ``[^\x20\x09-\x0D]+`` (Java regular expression).
SPACE_RE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    """``spark.sql.shuffle.partitions``: the session's own measure of how finely its data must be cut."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable is never inlined by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's checkout (a cluster installs it instead)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def as_rows(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so added columns cannot clash with the input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def numbered(df: DataFrame, order: list[str | Column], out: str, salt: str | None = None) -> DataFrame:
    """``df`` with ``out`` = place of the row (from 0) in ``order``, nulls first.

    Rows are range-partitioned and sorted inside each partition; one row per partition is broadcast
    as its offset. ``salt``, a column that tells equal rows apart and is the same whenever a task is repeated, lets a
    value that many rows share be cut into several tasks. The result is written out, as a second
    sampling of the ranges could number rows otherwise.
    """
    keys = [F.col(c).asc() if isinstance(c, str) else c for c in [*order, *([salt] if salt else [])]]
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), *keys)
    held = materialize(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    totals = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(starts), part == F.col("_part")).withColumn(out, place).drop("_at", "_part", "_start")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` (distinct in ``order``) with ``out`` = sum of ``value`` over the rows before, nulls first; cut as in :func:`numbered`."""
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), *[F.col(c).asc() for c in order])
    held = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(offsets), F.lit(0)).alias("_start"))
    inner = held.withColumn("_inner", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inner.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_inner")).drop("_part", "_start", "_inner")
