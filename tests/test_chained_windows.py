"""Chained windows against a plain loop: dense, sparse and negative times over many blocks, hot keys, ties."""
import random

from pyspark.sql import functions as F

from orderpulse.operators.chained_windows import BLOCK_WINDOWS, FANOUT, chained_windows
from orderpulse.operators.ratelimit import rate_limit_decisions

WIDTH = 10
LONGEST = WIDTH * BLOCK_WINDOWS * FANOUT ** 2


def plain(rows, width):
    """{(key, time, id): (window start, count)} by one loop over sorted rows."""
    out, state = {}, {}
    for k, t, i in sorted(rows):
        w, c = state.get(k, (None, 0))
        w, c = (t, 1) if w is None or t > w + width else (w, c + 1)
        state[k] = w, c
        out[k, t, i] = w, c
    return out


def times(rng):
    dense = [("hot", t) for t in range(-500, 2500)]                                # every unit, over block ends
    edge = [("edge", b * WIDTH * BLOCK_WINDOWS + d) for b in range(-70, 70) for d in (-1, 0, 9, 10, 11) if rng.random() < 0.6]
    sparse = [("sparse", rng.randrange(-3 * LONGEST, 3 * LONGEST)) for _ in range(400)]
    some = [("some", rng.randrange(0, 40 * WIDTH * BLOCK_WINDOWS)) for _ in range(900)]
    return dense + edge + sparse + some + [("one", 7), ("far", -LONGEST * 9), ("far", 2 ** 55), ("far", 2 ** 55 + WIDTH), ("far", 2 ** 55 + WIDTH + 1)]


def test_window_starts_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = sorted(set(times(rng)))
    want = {(k, t): w for (k, t, _), (w, _) in plain([(k, t, 0) for k, t in rows], WIDTH).items()}
    df = spark.createDataFrame(rows, "k string, t long").withColumn("n", F.lit(1).cast("bigint"))
    assert {(r.k, r.t): r.window_start for r in chained_windows(df, "k", "t", "n", WIDTH).collect()} == want
    assert chained_windows(df.limit(0), "k", "t", "n", WIDTH).count() == 0


def test_counts_with_ties_equal_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(k, t, 100 * i + j) for i, (k, t) in enumerate(times(rng)) for j in range(rng.choice((1, 1, 3)))]
    want = plain(rows, WIDTH)
    df = spark.createDataFrame(rows, "tenant_id string, req_ms long, request_id long").withColumn("ts", F.col("req_ms"))
    got = rate_limit_decisions(df, limit=F.lit(4), width=WIDTH).collect()
    assert {(r.tenant_id, r.req_ms, r.request_id): (r.window_start, r.request_count) for r in got} == want
    assert all(r.allowed == (r.request_count <= 4) for r in got)


def test_requests_without_a_time_pass(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2)], "tenant_id string, req_ms long, request_id long").withColumn("ts", F.col("req_ms"))
    got = {r.request_id: r for r in rate_limit_decisions(df, limit=F.lit(0)).collect()}
    assert got[1].allowed and got[1].request_count is None and not got[2].allowed


def test_whole_rows_are_shuffled_once_and_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a", 5, 2, "x")], "tenant_id string, req_ms long, request_id long, payload string").withColumn("ts", F.col("req_ms"))
    plan = rate_limit_decisions(df, limit=F.lit(1))._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "payload" in line]
    assert wide and not any("InPandas" in line for line in wide)
