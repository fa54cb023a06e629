"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``; each query runs once to warm up and
then ``BENCH_RUNS`` times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marlstone.plans.catalog import QUERIES  # noqa: E402
from marlstone.session import build_session  # noqa: E402

HEADLINE = [
    *(f"tpch_q{n}" for n in (1, 3, 4, 5, 6, 7, 8, 10, 12, 13, 14, 15, 17, 18, 19, 21, 22)),
    "report_month_deviation",
    "report_cumulative_lead",
    "report_rollup_rank",
    "report_return_ratio",
    "agg_cube",
    "agg_distinct",
    "agg_percentiles",
    "join_asof",
    "join_band",
    "join_multi_way",
    "top_k_per_group",
    "window_moving_average",
    "window_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
