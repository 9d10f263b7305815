"""Incremental ingest of saved pages with Structured Streaming.

New page files arriving in a folder are de-duplicated by page id and appended
to a Parquet table. ``trigger(availableNow=True)`` processes everything present
and stops, so the same job serves scheduled batch runs; the checkpoint makes
re-runs exactly-once. Pages carry no event time, so the de-duplication state
keeps every seen id; pass ``event_time`` to bound it with a watermark.

Thread documents are ingested without any keyed state: each micro-batch flattens its files into a
folder of its own, named by the batch, and reading takes the newest arrival of every thread. Repeating a batch
replaces its folder, so a re-run changes nothing; :func:`compact_threads` drops what later arrivals replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.operators.nesting import load_threads
from threadspark.schemas import CONTENT_COLUMNS, CONTENT_FIELDS
from threadspark.session import ensure_checkpoint_dir

PAGES_SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def page_stream(spark: SparkSession, source_dir: str, glob: str = "*.parquet", schema: T.StructType = PAGES_SCHEMA,
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_dir)


def table_files(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """Where the files of the table ``folder``/``name`` lie, a file or a folder of part files: (source_dir, glob)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return (f"{folder}/{name}", "*") if status.isDirectory() else (folder, name)


def ingest_pages(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str | None = None,
                 glob: str = "*.parquet", key: str = "page_id", event_time: str | None = None,
                 watermark: str = "1 day", schema: T.StructType = PAGES_SCHEMA) -> None:
    """Append every not-yet-seen record of ``source_dir`` to ``out_dir`` (runs until caught up).

    With ``event_time`` the de-duplication state is bounded by a watermark
    (``dropDuplicatesWithinWatermark``); without it every seen key is kept.
    """
    stream = page_stream(spark, source_dir, glob, schema)
    if event_time:
        # watermarks need TIMESTAMP; TIMESTAMP_NTZ sources are read in the session time zone
        stream = (
            stream.withColumn("_event_ts", F.col(event_time).cast("timestamp"))
            .withWatermark("_event_ts", watermark)
            .dropDuplicatesWithinWatermark([key])
            .drop("_event_ts")
        )
    else:
        stream = stream.dropDuplicates([key])
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark)}/ingest-{hashlib.md5(out_dir.encode()).hexdigest()}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


THREAD_COLUMNS = ", ".join(f"{n} {t.simpleString()}" for n, t in CONTENT_FIELDS)
UNITS_SCHEMA = f"root string, arrived timestamp, file string, path array<int>, {THREAD_COLUMNS}"
REJECTS_SCHEMA = "file string, arrived timestamp, path array<int>, id string, reason string"


def ingest_threads(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str | None = None, suffix: str = ".json",
                   max_files_per_trigger: int | None = None) -> None:
    """Flatten every not-yet-seen thread file below ``source_dir`` into ``out_dir`` (runs until caught up).

    ``out_dir``/units holds the accepted units, ``out_dir``/rejects what was refused and why, both one folder per batch.
    """
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.text(source_dir, wholetext=True).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived")).alias("thread"), "value"
    )

    def put(batch: DataFrame, number: int) -> None:
        loaded = load_threads(batch)
        roots = loaded.where(F.size("path") == 0).select("thread", F.col("id").alias("root"))
        units = loaded.where(F.col("reason").isNull()).join(roots, "thread")
        units.select("root", "thread.arrived", "thread.file", "path", *CONTENT_COLUMNS).write.mode("overwrite").parquet(f"{out_dir}/units/batch={number}")
        bad = loaded.where(F.col("reason").isNotNull()).select("thread.file", "thread.arrived", "path", "id", "reason")
        bad.write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={number}")

    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark)}/ingest-{hashlib.md5(out_dir.encode()).hexdigest()}"
    files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from threadspark.sources.readers import _path_exists

    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def current_threads(spark: SparkSession, out_dir: str) -> DataFrame:
    """The units of every thread's newest arrival: ``root`` and the content columns.

    Newest is by file time, then file name. One small aggregation finds it; a thread of any size is filtered, never gathered.
    """
    units = _read_batches(spark, f"{out_dir}/units", UNITS_SCHEMA)
    newest = units.groupBy(F.col("root").alias("_root")).agg(F.max(F.struct("arrived", "file")).alias("_newest"))
    held = units.join(newest, F.col("root") == F.col("_root")).where(F.struct("arrived", "file") == F.col("_newest"))
    return held.select("root", *CONTENT_COLUMNS)


def current_links(spark: SparkSession, out_dir: str) -> DataFrame:
    """The link map ``(post_id, url)`` of the ingested threads, newest arrival first."""
    return current_threads(spark, out_dir).where("is_post").select(F.col("id").alias("post_id"), "url")


def ingest_rejects(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every refused unit: file, arrived, path, id, reason."""
    return _read_batches(spark, f"{out_dir}/rejects", REJECTS_SCHEMA)


def compact_threads(spark: SparkSession, out_dir: str, target: str) -> None:
    """The current units as a plain content table at ``target``."""
    current_threads(spark, out_dir).write.mode("overwrite").parquet(target)
