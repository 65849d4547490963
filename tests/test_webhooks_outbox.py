"""J5 fan-out rules, P2 endpoint checks, S6/T4 outbox relay."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderpulse.functions.text import iso_instant, url_ok
from orderpulse.operators import outbox as obx
from orderpulse.operators import webhooks as wh

EP = "id string, tenant_id string, url string, secret string, event_types string, status string"


def test_fanout_counts_match_the_fanout(spark):
    rows = [(t, ty, f"{t}{ty}{i}", "{}", dt.datetime(2024, 1 + i % 2, 31 if i % 2 == 0 else 28, 23, 59))
            for t in ("a", "b", None) for ty in ("order.placed", "order.completed") for i in range(5)]
    ev = spark.createDataFrame(rows, "tenant_id string, event_type string, event_id string, payload string, event_time timestamp")
    eps = spark.createDataFrame([("1", "a", "order.placed, order.completed", "ACTIVE"), ("2", "a", "order.placed,order.placed", "ACTIVE"),
                                 ("3", "b", "order.completed", "DISABLED"), ("4", "c", "order.placed", "ACTIVE")],
                                "id string, tenant_id string, event_types string, status string")
    key = ["tenant_id", "event_type", F.date_trunc("month", "created_at").alias("created_at")]
    want = wh.webhook_fanout(ev, eps).groupBy(*key).agg(F.count(F.lit(1)).alias("deliveries"))
    got = wh.fanout_counts(ev, eps)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("deliveries")).first()[0] == 15


def test_fanout_subscriptions(spark):
    eps = spark.createDataFrame([
        ("e1", "tenant-1", "https://h/1", "s" * 16, "order.placed", "ACTIVE"),
        ("e2", "tenant-1", "https://h/2", "s" * 16, "order.completed", "ACTIVE"),
        ("e3", "tenant-1", "https://h/3", "s" * 16, "order.placed", "DISABLED"),
        ("e4", "tenant-1", "https://h/4", "s" * 16, " order.placed , order.placed", "ACTIVE"),
        ("e5", "tenant-2", "https://h/5", "s" * 16, "order.placed", "ACTIVE")], EP)
    ev = spark.createDataFrame([("tenant-1", "order.placed", "o1", "{}", dt.datetime(2024, 1, 1))],
                               "tenant_id string, event_type string, event_id string, payload string, event_time timestamp")
    got = sorted(r.endpoint_id for r in wh.webhook_fanout(ev, eps).collect())
    assert got == ["e1", "e4"]


def test_url_rule_and_iso_instant(spark):
    df = spark.createDataFrame([("https://x.io/h",), ("not-a-url",), ("http://",)], "u string")
    assert [r.ok for r in df.select(url_ok(F.col("u")).alias("ok")).collect()] == [True, False, False]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7),), (dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)],
                              "t timestamp")
    assert [r.s for r in t.select(iso_instant(F.col("t")).alias("s")).collect()] == \
        ["2024-01-01T00:00:07Z", "2024-01-01T00:00:07.179Z"]


def test_outbox_relay_state_machine(spark):
    good = '{"orderId":"o1"}'
    import base64
    b64 = base64.b64encode(good.encode()).decode()
    t0 = dt.datetime(2024, 1, 1)
    ob = spark.createDataFrame(
        [("a", "orders.placed", b64, t0, None, 0), ("b", "orders.placed", "!!!", t0, None, 0),
         ("c", "orders.placed", "e30=", t0, None, 4), ("d", "orders.placed", b64, t0, t0, 0)],
        "id string, topic string, payload string, created_at timestamp, processed_at timestamp, retry_count int")
    got = {r.id: (r.processed, r.retry_count, r.dead) for r in obx.outbox_status(ob).collect()}
    assert got == {"a": (True, 0, False), "b": (True, 5, True), "c": (True, 5, True), "d": (True, 0, False)}
    assert obx.outbox_dead_count(obx.outbox_status(ob)).first().dead_letters == 2
    assert obx.outbox_pending(ob).first().pending == 3
    # the monitor's scan wants unprocessed rows with 5+ retries; after the relay there are none (Q3)
    after = obx.outbox_status(ob).join(ob.select("id", "created_at"), "id")
    assert obx.outbox_dead_scan(after).count() == 0


def test_outbox_status_needs_no_attempts(spark):
    t0 = dt.datetime(2024, 1, 1)
    ob = spark.createDataFrame([("a", "t", "!!!", t0, None, -3), ("b", "t", "!!!", t0, None, 7), ("c", "t", "!!!", t0, t0, 2)],
                               "id string, topic string, payload string, created_at timestamp, processed_at timestamp, retry_count int")
    status = obx.outbox_status(ob)
    got = {r.id: (r.processed, r.retry_count, r.dead, (r.processed_at - t0).seconds, r.last_error) for r in status.collect()}
    assert got == {"a": (True, 5, True, 8, obx.DECODE_ERROR), "b": (True, 8, True, 1, obx.DECODE_ERROR), "c": (True, 2, False, 0, None)}
    plan = status._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_whole_events_survive_the_outbox(spark):
    """What S5 stores, S6 reads back: quotes in a value, milliseconds, defaults; a missing field is a failure."""
    from orderpulse.functions.text import to_base64
    from orderpulse.operators.orders import place_orders
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    rows = [("o1", 'cu"st\\', "prod-ü", 2, Decimal("19.99"), "EUR", t0, "c1", "t1"), ("o2", "c", "p", 1, Decimal("0.10"), "USD", t0, "c2", "t2")]
    orders = spark.createDataFrame(rows, "order_id string, customer_id string, product_id string, quantity int, amount decimal(12,2), "
                                         "currency string, placed_at timestamp, correlation_id string, tenant_id string")
    got = obx.outbox_events(place_orders(orders)[1]).orderBy("id").collect()
    assert [tuple(r)[3:-1] for r in got] == rows and all(r.ok and r.error is None for r in got)
    whole = '{"orderId":"o","customerId":"c","productId":"p","quantity":3,"amount":"1.00","placedAt":5,"correlationId":"x"}'
    texts = [("a", whole), ("b", whole.replace('"quantity":3,', "")), ("c", "[1]"), ("d", "null"), ("e", ""), ("f", None)]
    got = {r.id: r for r in obx.outbox_events(spark.createDataFrame(texts, "id string, body string").select(
        "id", F.lit("t").alias("topic"), to_base64(F.col("body")).alias("payload"))).collect()}
    assert (got["a"].currency, got["a"].tenant_id, got["a"].placed_at) == ("USD", "", dt.datetime(1970, 1, 1, 0, 0, 0, 5000))
    assert all(not got[k].ok and got[k].error == obx.DECODE_ERROR and got[k].order_id is None for k in "bcdef")
