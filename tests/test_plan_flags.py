"""No registered query plans a cartesian product, a nested-loop join, a
single-partition exchange over rows, or a row-at-a-time Python UDF."""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from plan_report import RED, single_partition_flags  # noqa: E402

from orderpulse.plans.catalog import load_all  # noqa: E402
from conftest import SF001


def test_no_red_plan_patterns(spark):
    bad = {}
    for k, q in load_all().items():
        plan = q.build(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        flags = [v for s, v in RED.items() if s in plan] + single_partition_flags(plan)
        if flags:
            bad[k] = flags
    assert bad == {}
