"""Bench: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_WARMUP (default 1).
Each query is run to completion with the ``noop`` sink (every row computed,
nothing collected).

Warm-up: before timing, every query runs once on the smallest fixture
(``sf0.001``), so JVM start-up and code generation, a fixed cost per query
shape, are not counted; each timed run then processes the whole table at
BENCH_SF_DIR once.  BENCH_WARMUP=0 times cold runs instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave.plans import catalog  # noqa: E402
from logweave.session import build_session, drop_written  # noqa: E402

HEADLINE = [
    "template_counts", "template_counts_by_host", "time_windows", "window_frequencies",
    "target_windows", "training_set", "window_mean_vector", "count_windows_sliding",
    "time_sorted_log", "similar_vectors", "sentences_by_source", "pair_counts",
    "cluster_potential", "logsig_scores", "logsig_signatures", "tree_metrics",
    "logsig_reassign", "logsig_clusters", "svm_metrics", "logreg_metrics", "template_embeddings",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    drop_written()
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", max(cpus, 8), app="logweave-bench",
                          extra={"spark.driver.memory": "16g"})
    run(spark, "line_count", sf_dir)          # warm-up: JVM, file listing
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir):
        for n in names:                       # code generation per query shape
            run(spark, n, warm_dir)
    times = {n: round(run(spark, n, sf_dir), 3) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "warm": os.environ.get("BENCH_WARMUP", "1") != "0",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
