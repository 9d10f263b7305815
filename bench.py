"""Benchmark: run the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (optional comma-separated subset). Each query is fully
materialised with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chain_prompts",
    "chains",
    "forest_prompts",
    "flatten_forest",
    "thread_pages",
    "html_paragraphs",
    "source_cleanup",
    "extract_links",
    "corpus_paragraph",
    "corpus_source",
    "corpus_chain",
    "tokens",
    "lemmas",
    "quality_rank",
    "trial_rank",
    "phrase_scores_default",
    "phrase_apply",
    "vocabulary",
    "bag_of_words",
    "coherence_umass",
    "doc_entropy",
    "topic_stability",
    "lda_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from threadspark.plans.catalog import QUERIES
    from threadspark.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="threadspark-bench")
    # start-up (session, Parquet reader, code generation) is not part of the first query's time
    QUERIES["doc_sample"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
