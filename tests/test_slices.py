"""Windows over slices of long keys equal a plain loop."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderpulse.operators.metrics import failure_rate
from orderpulse.operators.slices import with_slices

SCHEMA = "k string, t int, i int, failed boolean, calls_note string"


def _rows(n, seed=3):
    r = random.Random(seed)
    key = lambda i: None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}"
    return [(key(i), r.choice([None, *range(60)]), i, r.choice([True, False, None]), "x") for i in range(n)]


def _last_20(rows):
    flags, out = defaultdict(list), {}
    for k, t, i, failed, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        flags[k].append(failed is True)
        last = flags[k][-20:]
        out[i] = (len(last), sum(last), len(last) == 20 and sum(last) >= 10)
    return out


@pytest.mark.parametrize("rows_per_slice", [1, 3, 40, 10**6])
def test_failure_rate_is_the_plain_window(spark, rows_per_slice):
    rows = _rows(900)
    got = failure_rate(spark.createDataFrame(rows, SCHEMA), "k", ["t", "i"], rows_per_slice=rows_per_slice).collect()
    assert {x.i: (x.calls, x.failures, x.flagged) for x in got} == _last_20(rows)
    assert len(got) == len(rows) and all(x.failure_rate == x.failures / x.calls for x in got)


def test_failure_rate_of_no_rows(spark):
    df = failure_rate(spark.createDataFrame([], SCHEMA), "k", ["t", "i"])
    assert df.count() == 0 and df.columns == ["k", "t", "i", "failed", "calls_note", "calls", "failures", "failure_rate", "flagged"]


def test_a_hot_key_has_many_ordered_slices(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("t"))
    got = with_slices(df, "k", ["t"], rows_per_slice=640).where("k = -1").groupBy("_slice").agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_slice").collect()
    assert len(got) > 15 and max(x.n for x in got) < 3000
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


def test_whole_rows_are_shuffled_once_and_not_checkpointed(spark):
    df = failure_rate(spark.createDataFrame(_rows(50), SCHEMA), "k", ["t", "i"])
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    shuffles = [part for part in plan.split("\n\n") if ") Exchange" in part and "Input" in part]
    assert sum("calls_note" in part for part in shuffles) == 1 < len(shuffles)
    assert "MapInArrow" not in plan and "BatchEval" not in plan
