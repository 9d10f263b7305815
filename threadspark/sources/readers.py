"""Sources (S1-S10): thread documents, chain tables, trial logs, link maps, saved pages.

Every reader is a DataFrame scan with an explicit schema where one exists;
nothing is read on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.operators.nesting import load_threads
from threadspark.operators.pages import hash_order
from threadspark.schemas import CHAIN_EXTRA, CONTENT_SCHEMA, TRIAL_SCHEMA

CHAIN_SCHEMA = T.StructType(CONTENT_SCHEMA.fields + CHAIN_EXTRA.fields)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def list_files(spark: SparkSession, directory: str, suffix: str = ".json") -> DataFrame:
    """S1 without content: ``(path, length)`` of every file under ``directory`` (recursive) whose name ends with ``suffix``.

    The binary source reads a file only when its content column is asked for, so this is a listing.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
        .load(directory).select("path", "length")
    )


def thread_files(spark: SparkSession, directory: str | list[str], suffix: str = ".json") -> DataFrame:
    """Every file under ``directory`` (recursive; or the files named in a list) whose name ends with ``suffix``:
    ``(path, value)`` with the whole file text in ``value``."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def sample_files(files: DataFrame, n: int | None, seed: int = 0, key: Column | None = None) -> DataFrame:
    """``min(n, N)`` rows of a listing without replacement by seeded hash order of ``key`` (default: the path; all when ``n`` is None)."""
    if n is None:
        return files
    return files.orderBy(hash_order(F.col("path") if key is None else key, seed), "path").limit(n)


def sampled_thread_files(spark: SparkSession, directory: str, n: int, seed: int = 0, suffix: str = ".json", key: Column | None = None) -> DataFrame:
    """S1 + S4: the text of ``n`` sampled files. The sample is drawn from the listing; its ``n`` names come to the driver and only those files are read."""
    names = [r["path"] for r in sample_files(list_files(spark, directory, suffix), n, seed, key).collect()]
    if not names:
        return spark.createDataFrame([], "path string, value string")
    return thread_files(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in names], suffix)


def thread_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 for JSON Lines (what K4 writes): ``(path, value)``, one document per line; ``path`` is the post's id.

    Lines without a readable id share a null ``path``; ``unreadable_documents`` reports those that are not JSON.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.try_variant_get(F.try_parse_json("value"), "$.id", "string").alias("path"), "value")


def load_files(
    spark: SparkSession, directory: str, max_docs: int | None = None, seed: int = 0, fmt: str = "files", suffix: str = ".json", key: Column | None = None
) -> DataFrame:
    """Every unit of all (or a sample of) thread documents with ``reason``, null unless the row is rejected.

    ``fmt``: ``files`` (one document per file) or ``lines`` (JSON Lines, as K4 writes them).
    Rows carry ``thread`` (the file path, or the post's id) and ``path`` (child ordinals from the
    root); ordering by both gives the pre-order of every tree. An empty directory gives an empty table.
    """
    if fmt == "files" and max_docs is not None:
        docs = sampled_thread_files(spark, directory, max_docs, seed, suffix, key)
    elif fmt == "files":
        # a scan packs few small files into a task, and every level of the trees has as many tasks as the scan
        docs = thread_files(spark, directory, suffix).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        docs = sample_files(thread_lines(spark, directory), max_docs, seed, key)
    if docs.isEmpty():
        return spark.createDataFrame([], CONTENT_SCHEMA).select(
            F.lit(None).cast("string").alias("thread"), F.array().cast("array<int>").alias("path"), "*", F.lit(None).cast("string").alias("reason")
        )
    return load_threads(docs, json_col="value", key_col="path")


def read_threads(spark: SparkSession, directory: str, max_docs: int | None = None, seed: int = 0, fmt: str = "files", **options) -> DataFrame:
    """The accepted units of :func:`load_files`."""
    return load_files(spark, directory, max_docs, seed, fmt, **options).where(F.col("reason").isNull()).drop("reason")


def read_chain_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Chain table from Parquet, or from CSV (children ids stored as JSON text)."""
    if fmt == "parquet":
        return spark.read.schema(CHAIN_SCHEMA).parquet(path)
    csv_schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "children_ids" else f.dataType, True) for f in CHAIN_SCHEMA.fields]
    )
    df = spark.read.schema(csv_schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("children_ids", F.from_json("children_ids", "array<string>"))


def chain_head(chains: DataFrame, n: int = 100) -> DataFrame:
    """S6 head: the first ``n`` chain rows in (chain_id, chain_rank) order."""
    return chains.orderBy("chain_id", "chain_rank").limit(n)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial log with the fixed schema; a missing log is an empty table.

    Reads appended files and per-trial sub-folders (parallel search) alike.
    """
    if not _path_exists(spark, path):
        return spark.createDataFrame([], TRIAL_SCHEMA)
    return spark.read.schema(TRIAL_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def read_link_map(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Link map as ``(post_id, url)``; missing -> empty.

    ``fmt``: ``json`` (objects post id -> url) or ``parquet`` (the table K6 writes).
    """
    if not _path_exists(spark, path):
        return spark.createDataFrame([], "post_id string, url string")
    if fmt == "parquet":
        return spark.read.schema("post_id string, url string").parquet(path)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("post_id", "url"))


def read_saved_pages(spark: SparkSession, directory: str, suffix: str = ".html", fmt: str = "files") -> DataFrame:
    """Saved pages as ``(page_id, html)``.

    ``fmt``: ``files`` (the page id is the file name without suffix) or ``parquet`` (the table K5 writes).
    """
    if fmt == "parquet":
        return spark.read.parquet(directory).select(F.col("page_id").cast("string").alias("page_id"), "html")
    files = thread_files(spark, directory, suffix)
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    page_id = F.regexp_replace(name, r"\Q" + suffix + r"\E$", "")
    return files.select(page_id.alias("page_id"), F.col("value").alias("html"))


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The prediction table K3 writes (Parquet or CSV); :func:`search.seed_trials` takes the seeds from it."""
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)
