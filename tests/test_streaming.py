"""Incremental ingest with Structured Streaming (availableNow), with and without a watermark."""

import tempfile

from pyspark.sql import types as T

from threadspark.streaming import ingest as Z

SF = "/root/testdata/sf0.001"


def test_ingest_pages_dedup(spark):
    base = tempfile.mkdtemp(prefix="ts-z1-")
    Z.ingest_pages(spark, SF, f"{base}/out", f"{base}/state", glob="pages.parquet")
    Z.ingest_pages(spark, SF, f"{base}/out", f"{base}/state", glob="pages.parquet")  # re-run: nothing new
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == out.select("page_id").distinct().count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_ingest_events_with_watermark(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    assert isinstance(schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType))
    base = tempfile.mkdtemp(prefix="ts-z1w-")
    Z.ingest_pages(spark, SF, f"{base}/out", f"{base}/state", glob="events.parquet", key="event_id",
                   event_time="ts", watermark="1 hour", schema=schema)
    out = spark.read.parquet(f"{base}/out")
    src = spark.read.parquet(f"{SF}/events.parquet")
    assert out.count() == src.select("event_id").distinct().count()


def test_threads_ingested_newest_arrival_wins(spark):
    import json
    import os

    def unit(id, parent, text, is_post=False, replies=()):
        return {"url": f"u/{id}/{text}", "text": text, "date": "d", "id": id, "parent_id": parent, "is_post": is_post, "replies": list(replies)}

    base = tempfile.mkdtemp(prefix="ts-z1t-")
    os.makedirs(f"{base}/in/one")

    def arrive(name, doc, when):
        with open(f"{base}/in/{name}", "w") as f:
            f.write(doc if isinstance(doc, str) else json.dumps(doc))
        os.utime(f"{base}/in/{name}", (when, when))

    def state():
        rows = {(r.root, r.id, r.text) for r in Z.current_threads(spark, f"{base}/out").collect()}
        return rows, {(r.post_id, r.url) for r in Z.current_links(spark, f"{base}/out").collect()}

    assert state() == (set(), set())
    arrive("one/p1.json", unit("p1", None, "old", True, [unit("c1", "p1", "x"), unit("c2", "p1", "gone")]), 1_000_000)
    arrive("p2.json", unit("p2", None, "other", True), 1_000_000)
    Z.ingest_threads(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    first = state()
    assert first[0] == {("p1", "p1", "old"), ("p1", "c1", "x"), ("p1", "c2", "gone"), ("p2", "p2", "other")}
    Z.ingest_threads(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    assert state() == first  # nothing new
    arrive("p1-again.json", unit("p1", None, "new", True, [unit("c1", "p1", "edited"), None, unit("c3", "p1", "late", replies=[{"id": "c4"}])]), 2_000_000)
    arrive("broken.json", "{oops", 2_000_000)
    Z.ingest_threads(spark, f"{base}/in", f"{base}/out", f"{base}/state", max_files_per_trigger=1)
    rows, links = state()
    assert rows == {("p1", "p1", "new"), ("p1", "c1", "edited"), ("p1", "c3", "late"), ("p2", "p2", "other")}
    assert links == {("p1", "u/p1/new"), ("p2", "u/p2/other")}
    assert sorted((r.id, r.reason) for r in Z.ingest_rejects(spark, f"{base}/out").collect() if r.id) == [("c4", "missing url")]
    assert [r.reason for r in Z.ingest_rejects(spark, f"{base}/out").collect() if not r.id] == ["not JSON"]
    arrive("p1-older.json", unit("p1", None, "stale", True), 1_500_000)  # an older copy that arrives late changes nothing
    Z.ingest_threads(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    assert state() == (rows, links)
    Z.compact_threads(spark, f"{base}/out", f"{base}/table")
    assert spark.read.parquet(f"{base}/table").count() == len(rows)


def test_incremental_pages_reads_a_folder_of_part_files(spark, tmp_path):
    from threadspark.plans.catalog import QUERIES

    rows = [(k % 40, f"u{k % 40}", f"<p>{k % 40}</p>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["incremental_pages"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(set(rows))
