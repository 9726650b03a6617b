"""Headline benchmark: prints ONE JSON line.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]``; per query the median of 3 timed runs after one
warm-up, each run forced with a ``noop`` write (full evaluation, no
collect to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "file_metrics", "halstead_code", "project_health", "folder_rollup", "rank_issues", "parse_bug_scan",
    "fix_outcomes", "path_nodes", "path_edges", "loc", "node_depth_markup", "debt_trend", "upsert_latest",
    "describe", "triage", "describe_missing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from lintel.session import get_spark
    from lintel.plans.catalog import QUERIES
    spark = get_spark(f"local[{cpus}]", app="lintel-bench", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2)),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lintel-bench-"),
    })
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        ts = []
        for _ in range(runs):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t)
        times[name] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
