"""The gateway rate limit (burst example, FIXTURES.md C per-tenant counts)."""
import datetime as dt

from pyspark.sql import functions as F

from orderpulse.operators.ratelimit import rate_limit_decisions
from orderpulse.sources import tables as tb
from conftest import SF001, SF01

SCHEMA = "request_id long, tenant_id string, req_ms long, ts timestamp, plan string"


def _burst(spark, n, plan, tenant="t1", step_ms=0):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, tenant, i * step_ms, t0 + dt.timedelta(microseconds=i), plan)
                                  for i in range(n)], SCHEMA)


def test_burst_of_101_on_free_refuses_the_last(spark):
    got = rate_limit_decisions(_burst(spark, 101, "FREE")).orderBy("request_id").collect()
    assert all(r.allowed for r in got[:100]) and not got[100].allowed
    assert got[99].remaining == 0 and got[0].remaining == 99


def test_window_resets_after_sixty_seconds(spark):
    got = rate_limit_decisions(_burst(spark, 3, "FREE", step_ms=30001)).orderBy("request_id").collect()
    assert [r.request_count for r in got] == [1, 2, 1]
    assert [r.window_start for r in got] == [0, 0, 60002]


def test_enterprise_and_missing_tenant_pass_uncounted(spark):
    df = _burst(spark, 150, "ENTERPRISE").unionByName(
        _burst(spark, 150, "FREE", tenant=None).withColumn("request_id", F.col("request_id") + 1000))
    got = rate_limit_decisions(df).collect()
    assert all(r.allowed for r in got) and all(r.request_count is None for r in got)


def _per_tenant(spark, d):
    r = rate_limit_decisions(tb.requests_log(spark, d))
    g = r.groupBy("tenant_id").agg(F.count(F.when(F.col("allowed"), 1)).alias("a"),
                                   F.count(F.when(~F.col("allowed"), 1)).alias("r"))
    return {x.tenant_id: (x.a, x.r) for x in g.collect()}


def test_counts_per_tenant_match_fixture(spark):
    assert _per_tenant(spark, SF001) == {"0": (193, 0), "1": (179, 0), "2": (216, 0), "3": (186, 0),
                                         "4": (218, 8)}
    assert _per_tenant(spark, SF01) == {"0": (513, 1511), "1": (1323, 637), "2": (2063, 0),
                                        "3": (1965, 0), "4": (489, 1499)}
