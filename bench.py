"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion with the ``noop`` sink (all rows
produced, nothing collected to the driver): one warm-up run, then the median of
``BENCH_RUNS`` timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobsight.plans.registry import all_queries  # noqa: E402
from jobsight.session import build_session, env_int  # noqa: E402

HEADLINE = [
    "a1_tenant_queue_stats", "a4_user_metrics", "a12_attempt_summary", "a10_duration_trend",
    "j12_workflow_view", "w3_allocate_claims", "w4_offered_load", "u4_idempotency_conflicts",
    "b1_created_jobs", "b8_fail_jobs", "b5_reclaim_outbox", "c2_cron_occurrences", "c3_next_fire",
    "d2_ready_children", "d5_ancestors", "t4_admission_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = env_int("BENCH_CPUS", 8)
    runs = env_int("BENCH_RUNS", 3)
    spark = build_session(f"local[{cpus}]", app="jobsight-bench", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries = all_queries()
    names = [n for n in HEADLINE if n in queries]
    if os.environ.get("BENCH_ALL"):
        names = sorted(queries)
    timings: dict[str, float] = {}
    for name in names:
        fn = queries[name].fn

        def once() -> float:
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t

        once()  # warm-up (JIT, file listing, broadcast build)
        timings[name] = round(statistics.median(once() for _ in range(max(1, runs))), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
