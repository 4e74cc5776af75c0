"""Plan summary of every registered query: scans, shuffles, broadcasts, risky operators.

    python -m fraudscope.plans.explain [sf_dir] [query ...]

Used to keep PLANS.md honest: a query whose final plan gains a CartesianProduct,
a BroadcastNestedLoopJoin or unexpected shuffles shows up here.
"""

from __future__ import annotations

import re
import sys

SKIP = {"gbt_fit_score", "rf_fit_score", "top_features", "train_report", "model_roundtrip", "stream_score",
        "audit_append", "stream_minute", "csv_roundtrip", "schema_check"}
FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin", "BroadcastHashJoin",
         "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas", "Window", "TakeOrderedAndProject"]


def summarize(plan: str) -> dict:
    return {
        "scans": plan.count("Scan parquet"),
        "local": plan.count("LocalTableScan") + plan.count("Scan ExistingRDD"),
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                                   plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "flags": [f for f in FLAGS if f in plan],
    }


def main(argv) -> int:
    from ..session import local_session
    from .catalog import queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    q = queries()
    names = argv[2:] or [n for n in sorted(q) if n not in SKIP]
    spark = local_session(8)
    for n in names:
        plan = q[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"{n:22s} scans={s['scans']} local={s['local']} shuffles={s['shuffles']} "
              f"broadcasts={s['broadcasts']} {s['flags']}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
