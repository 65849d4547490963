"""Webhook delivery outcomes (reference examples, Q1/Q2 and FIXTURES.md C)."""
import datetime as dt

from pyspark.sql import functions as F

from orderpulse.operators.delivery import delivery_status, due_retries
from orderpulse.sources import tables as tb
from conftest import SF001, SF01

SCHEMA = "delivery_id long, attempt_id long, ts timestamp, http_status int, error string"
T0 = dt.datetime(2024, 1, 1)


def _attempts(spark, outcomes, d=1):
    rows = [(d, i, T0 + dt.timedelta(minutes=i), h, None if h is not None else "timeout")
            for i, h in enumerate(outcomes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_200_is_delivered(spark):
    r = delivery_status(_attempts(spark, [200])).first()
    assert (r.status, r.attempt_count, r.last_http_status) == ("DELIVERED", 1, 200)
    assert r.delivered_at == T0


def test_500_fails_with_retry_time(spark):
    r = delivery_status(_attempts(spark, [500])).first()
    assert (r.status, r.attempt_count, r.last_error) == ("FAILED", 2, "HTTP 500")
    assert r.next_attempt_at == T0 + dt.timedelta(seconds=60)


def test_http_failures_count_twice_and_exhaust_on_the_third(spark):
    r = delivery_status(_attempts(spark, [500, 500, 500, 200])).first()
    assert (r.status, r.attempt_count, r.outcomes_used, r.outcomes_seen) == ("EXHAUSTED", 5, 3, 4)


def test_five_exceptions_leave_a_stuck_delivery(spark):
    r = delivery_status(_attempts(spark, [None] * 6)).first()
    assert (r.status, r.attempt_count, r.stuck) == ("FAILED", 5, True)
    assert due_retries(delivery_status(_attempts(spark, [None] * 6)), F.lit(T0 + dt.timedelta(days=1))).count() == 0


def _summary(spark, d):
    s = delivery_status(tb.attempts(spark, d))
    return {(r.status, r.stuck): r["count"] for r in s.groupBy("status", "stuck").count().collect()}


def test_fixture_counts(spark):
    assert _summary(spark, SF001) == {("DELIVERED", False): 92, ("EXHAUSTED", False): 57, ("FAILED", True): 51}
    assert _summary(spark, SF01) == {("DELIVERED", False): 991, ("EXHAUSTED", False): 531, ("FAILED", True): 478}


def test_final_state_is_the_last_of_the_attempt_states(spark):
    """Random outcomes, equal times, a delivery with most rows, and a null id, against the fold of every attempt."""
    import random

    from orderpulse.operators.delivery import attempt_states
    r = random.Random(5)
    rows = [(None if i % 90 == 0 else 0 if i % 2 else r.randint(1, 60), i, T0 + dt.timedelta(seconds=r.randint(0, 50)),
             http := r.choice([None, 200, 204, 404, 500, 500, 302]), None if http is not None else r.choice(["timeout", None])) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ("status", "attempt_count", "last_http_status", "last_error", "next_attempt_at", "delivered_at")
    want = {}
    for x in sorted(attempt_states(df.where("delivery_id is not null")).collect(), key=lambda x: (x.ts, x.attempt_id)):
        want[x.delivery_id] = tuple(x[c] for c in cols)
    got = delivery_status(df).collect()
    assert {x.delivery_id: tuple(x[c] for c in cols) for x in got if x.delivery_id is not None} == want
    assert sum(x.outcomes_seen for x in got) == len(rows) and len([x for x in got if x.delivery_id is None]) == 1
    assert all(1 <= x.outcomes_used <= min(5, x.outcomes_seen) for x in got)


def test_only_first_outcomes_are_shuffled(spark):
    plan = delivery_status(spark.createDataFrame([(1, 1, T0, 200, None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" not in plan and "Arrow" not in plan
