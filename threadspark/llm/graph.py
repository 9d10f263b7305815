"""Connected components as DataFrame rounds (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (u, v) -> (node, root): the smallest node reachable, for every node but the roots.

    Each round hangs neighbours on the smallest one (large stars, then small stars), so
    paths shorten geometrically and no node's neighbours are ever gathered: only
    minima are aggregated and joins on a hot node can be split. A round is
    checkpointed in the shared folder; the loop ends when a round changes nothing.
    """
    cur = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(cur)
    while mark[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
