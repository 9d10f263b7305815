"""Sinks (K1-K7). Writes are idempotent (overwrite) except the append-only trial log."""

from __future__ import annotations

from pyspark.ml.clustering import LocalLDAModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadspark.operators.nesting import nest_fragments, nest_threads
from threadspark.sources.readers import read_trials


def write_chain_table(chains: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: chain table as Parquet (arrays kept) or CSV (arrays as JSON text, quotes escaped)."""
    if fmt == "parquet":
        chains.write.mode("overwrite").parquet(path)
        return
    out = chains
    if "children_ids" in chains.columns:
        out = out.withColumn("children_ids", F.to_json("children_ids"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """K2: append trial records to the Parquet trial log."""
    trials.write.mode("append").parquet(path)


def compact_trials(spark: SparkSession, path: str, target: str, files: int = 1) -> None:
    """K2: the trial log at ``path`` as a new log of ``files`` files at ``target``; a trial logged twice stays once (its ``ok`` record if it has one)."""
    log = read_trials(spark, path)
    order = [(F.col("status") == "ok").desc_nulls_last(), F.xxhash64(*log.columns)]
    known = log.where(F.col("trial_id").isNotNull())
    once = known.withColumn("_k", F.row_number().over(Window.partitionBy("trial_id").orderBy(*order))).where("_k = 1").drop("_k")
    once.unionByName(log.where(F.col("trial_id").isNull())).repartition(files).write.mode("errorifexists").parquet(target)


def write_predictions(pred: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K3: predicted parameter table."""
    w = pred.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_thread_documents(units: DataFrame, path: str, order_col: str | None = None, fmt: str = "lines") -> None:
    """K4: nested JSON documents, one per post.

    ``lines``: JSON Lines, a document per row. ``files``: a text file per post below ``path``/thread=<id>, written
    unit by unit from the sorted fragments, so a thread of any size streams to its file.
    """
    if fmt == "lines":
        nest_threads(units, order_col).select("json").write.mode("overwrite").text(path)
        return
    # a partition column that may be null is rewritten before the write, which would sort again by it alone and lose the order of paths
    rows = nest_fragments(units, order_col).withColumn("thread", F.coalesce("thread", F.lit("")))
    rows = rows.repartition("thread").sortWithinPartitions("thread", "path")
    # every task puts its own files in place: with the other committer the driver alone moves them all, one by one, at the end
    out = rows.select("thread", "fragment").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.partitionBy("thread").text(path)


def write_pages(pages: DataFrame, path: str, partition_col: str | None = None) -> None:
    """K5: saved pages as Parquet, optionally partitioned (e.g. by crawl batch)."""
    w = pages.write.mode("overwrite")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def write_link_map(links: DataFrame, path: str) -> None:
    """K6: link map ``(post_id, url)``, replaced as a whole."""
    links.select("post_id", "url").write.mode("overwrite").parquet(path)


def save_topic_model(model: LocalLDAModel, vocab: DataFrame, path: str) -> None:
    """K7: the LDA model and its vocabulary side by side."""
    model.write().overwrite().save(f"{path}/model")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_topic_model(spark: SparkSession, path: str) -> tuple[LocalLDAModel, DataFrame]:
    """K7: load what :func:`save_topic_model` wrote."""
    return LocalLDAModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary")
