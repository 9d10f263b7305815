"""Compare registered Spark queries with their DuckDB oracles (local check tool).

Usage: ``python -m threadspark.plans.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def _digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from threadspark.plans.catalog import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLES:
        res["status"] = "rows-only"
        return res
    cur = con.execute(ORACLES[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    res["duck_rows"] = len(d_rows)
    res["duck_sec"] = round(time.time() - t1, 2)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    hs, ls = _digest(s_cols, s_rows)
    hd, ld = _digest(d_cols, d_rows)
    if hs == hd:
        res["status"] = "match"
    else:
        only_s = sorted(set(ls) - set(ld))[:2]
        only_d = sorted(set(ld) - set(ls))[:2]
        res["status"] = "value mismatch"
        res["example_spark"] = [x[:300] for x in only_s]
        res["example_duck"] = [x[:300] for x in only_d]
    return res


def main(argv):
    from threadspark.plans.catalog import QUERIES
    from threadspark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(QUERIES)
    spark = local_session()
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue with the next query
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "rows-only")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
