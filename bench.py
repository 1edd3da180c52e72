"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is executed to completion with the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Session start-up and a
small warm-up query are not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactum.plans.queries import QUERIES  # noqa: E402
from pactum.session import get_spark  # noqa: E402

WARMUP_SF = "/root/testdata/sf0.001"
HEADLINE = [
    "full_text", "flat_annotations", "build_tables", "integrity_report", "scenario_split",
    "training_schedule", "postings", "search_topk", "search_snippet", "read_by_id",
    "search_replay", "rubric", "benchmark_means", "validate_nested", "index_upsert",
    "tool_reply", "scenario_sample", "load_nested", "load_envelope",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = list(QUERIES) if sys.argv[1:] == ["--all"] else sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", partitions=cpus)
    # Warm-up (not timed): JIT-compile the JVM paths on the smallest tables.
    for name in ("flat_annotations", "search_topk", "rubric"):
        QUERIES[name](spark, WARMUP_SF).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
