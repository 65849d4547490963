"""Print the physical plan shape of registered queries and flag red patterns.

    python tools/plan_report.py [--sf 0.01] [key ...]

Flags: cartesian products, nested-loop joins, single-partition exchanges over
rows (a global sort or window with no partition key; over an aggregate they
are fine), and row-at-a-time Python UDFs.
"""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from orderpulse.plans.catalog import load_all  # noqa: E402
from orderpulse.session import get_spark  # noqa: E402

RED = {
    "CartesianProduct": "cartesian product",
    "BroadcastNestedLoopJoin": "nested-loop join",
    "BatchEvalPython": "row-at-a-time Python UDF",
}


def single_partition_flags(plan: str) -> list[str]:
    """A single-partition exchange is fine over an aggregate (one row per task
    or per group of a small table, e.g. a global count or the partition-offset
    table); anything else (a global sort or window over rows) is flagged."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if "HashAggregate" not in child and "ObjectHashAggregate" not in child:
                out.append("single-partition exchange over rows")
    return out
COUNT = ("Exchange", "BroadcastExchange", "MapInPandas", "FlatMapGroupsInPandas", "Scan parquet",
         "Scan ExistingRDD", "TakeOrderedAndProject", "SortMergeJoin", "BroadcastHashJoin")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = get_spark()
    qs = load_all()
    for k in a.keys or list(qs):
        plan = qs[k].build(spark, f"/root/testdata/sf{a.sf}")._jdf.queryExecution().executedPlan().toString()
        counts = {c: len(re.findall(re.escape(c) + r"\b", plan)) for c in COUNT}
        shape = ", ".join(f"{c}={n}" for c, n in counts.items() if n)
        flags = [v for s, v in RED.items() if s in plan] + single_partition_flags(plan)
        print(f"{k:28s} {shape}" + (f"  !! {', '.join(flags)}" if flags else ""), flush=True)


if __name__ == "__main__":
    main()
