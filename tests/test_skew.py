"""A post owning a third of all rows: chains, counts and prompts stay whole and exact."""

import random

from pyspark.sql import functions as F

from threadspark.operators import prompts as L
from threadspark.operators import threads as T
from threadspark.schemas import CONTENT_SCHEMA


def _forest(n_hot=400, n_threads=40, seed=3):
    rng = random.Random(seed)
    rows = [("hot", None, True)]
    rows += [(f"h{i}", "hot", False) for i in range(n_hot)]             # one third of all rows under one post
    rows += [(f"h{i}r", f"h{i}", False) for i in range(0, n_hot, 7)]     # some replies below them
    for t in range(n_threads):
        rows.append((f"p{t}", None, True))
        ids = [f"p{t}"]
        for j in range(rng.randint(3, 15)):
            cid = f"p{t}c{j}"
            rows.append((cid, rng.choice(ids), False))
            ids.append(cid)
    return rows


def _chains_bruteforce(rows):
    parent = {i: p for i, p, _ in rows}
    post = {i: ip for i, _, ip in rows}
    has_child = {p for _, p, _ in rows if p is not None}
    out = {}
    for i, _, _ in rows:
        if i in has_child:
            continue
        chain, cur = [], i
        while True:
            chain.append(cur)
            if post[cur]:
                break
            cur = parent[cur]
        out[i] = chain[::-1]
    return out


def test_hot_post(spark):
    rows = _forest()
    full = [("u", None, None, "", None, "usr", f"<p>{i}</p>", "d", None, i, p, ip, "T" if ip else None) for i, p, ip in rows]
    units = spark.createDataFrame(full, CONTENT_SCHEMA)
    prev = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                           "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
                                           "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # make the hot key count as skewed and keep joins as shuffles, so the split path runs
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        members = T.chain_members(units).collect()
        counts = {r.parent_id: r.child_count for r in T.child_counts(units).collect()}
        prompts = L.chain_prompts(units).where(F.col("chain_id") == "h3").collect()
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    got = {}
    for r in members:
        got.setdefault(r.chain_id, []).append((r.chain_rank, r.id))
    got = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    assert got == _chains_bruteforce(rows)
    assert counts["hot"] == 400
    assert len(prompts) == 2 and all(r.prompt.startswith("Post by usr, title: T, initial comment: hot") for r in prompts)
