"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}.  Each query is executed in full through the
``noop`` sink (no driver collect).  One untimed warm-up pass over sf0.001
starts the Python workers and JIT before timing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orderpulse.plans.catalog import load_all  # noqa: E402
from orderpulse.session import get_spark  # noqa: E402

HEADLINE = [
    "saga_summary", "stock_reservation", "order_completion", "rate_limit", "delivery_status",
    "webhook_fanout", "sign_payloads", "monthly_usage_all", "invoice_amounts", "outbox_status",
    "outbox_relay", "failure_rate", "latency_p99_hist", "orders_per_minute", "resolve_api_keys",
    "validate_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = load_all()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for k in HEADLINE:
            qs[k].build(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for k in HEADLINE:
        t0 = time.perf_counter()
        qs[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
