"""Summarise the physical plan of every registered query: shuffles,
broadcasts, single-partition exchanges, cartesian products, and what each
parquet scan reads (ReadSchema) and pushes down (PushedFilters).

Usage: python scripts/plan_report.py [sf_dir] [key ...]  (prints markdown)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pactum.plans.queries import QUERIES  # noqa: E402
from pactum.session import get_spark  # noqa: E402


def summarise(plan: str) -> dict:
    # AQE hides the final plan until execution; the initial plan is what
    # Catalyst chose before runtime re-planning.
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:\s|$)", plan))),
        "pushed": sorted(set(f for f in re.findall(r"PushedFilters: \[([^\]\n]*)\]", plan) if f)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = get_spark()
    print("| query | shuffles | broadcasts | single-partition | cartesian | parquet ReadSchema | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for k in keys:
        df = QUERIES[k](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        scans = "<br>".join(x.replace("|", "/") for x in s["scans"])
        print(f"| {k} | {s['exchanges']} | {s['broadcasts']} | {s['single_partition']} | {s['cartesian']} | "
              f"{scans} | {'; '.join(s['pushed'])} |")


if __name__ == "__main__":
    main()
