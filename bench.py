"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
Each query's result is computed in full into a sink that discards it; the best of BENCH_RUNS runs (default 2) counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.check import session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "register_build",
    "export_register_json",
    "scan_register_csv",
    "fuzzy_search_topk",
    "fuzzy_search_two_fields",
    "choose_and_write",
    "cluster_points",
    "bounds",
    "geocode_join",
    "update_by_id",
    "columns_to_rows",
    "first_match",
    "assign_ids",
    "normalize_index",
    "normalize_query",
    "parse_diff_cell",
    "debounce",
    "debounce_stream",
    "geocode_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus, 8 if cpus == "*" else int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    line = {
        "metric": "total of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
