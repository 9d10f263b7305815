"""Validation complement of the flattener and ordered de-duplication."""

import json

from threadspark.operators import nesting as N
from threadspark.operators import threads as T


def test_invalid_units(spark):
    good = {"url": "u", "text": "<p>a</p>", "date": "d", "id": "p1", "is_post": True, "replies": [
        {"url": "u", "text": "<p>b</p>", "id": "c1", "parent_id": "p1", "is_post": False, "replies": []}]}  # c1 lacks date
    docs = spark.createDataFrame([("t", json.dumps(good))], "thread string, value string")
    flat = N.flatten_threads(docs, validate=False)
    assert sorted(r.id for r in flat.collect()) == ["c1", "p1"]
    assert [r.id for r in N.invalid_units(flat).collect()] == ["c1"]
    assert [r.id for r in N.flatten_threads(docs).collect()] == ["p1"]


def test_dedupe_with_order(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only")], "id string, seq int, v string")
    got = {r.id: r.v for r in T.dedupe_units(df, order=["seq"]).collect()}
    assert got == {"a": "early", "b": "only"}
    assert T.dedupe_units(df, order=["seq"]).columns == df.columns


def test_bad_documents_do_not_stop_the_load(spark):
    good = '{"id": "p1", "upvotes": "n/a", "replies": 5}'
    docs = spark.createDataFrame([("a", good), ("b", "{oops"), ("c", None)], "thread string, value string")
    assert [r.id for r in N.flatten_threads(docs, validate=False).collect()] == ["p1"]
    assert {(r.thread, r.reason) for r in N.unreadable_documents(docs).collect()} == {("b", "not JSON"), ("c", "missing document")}
