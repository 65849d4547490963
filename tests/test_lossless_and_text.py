"""The ordered fold leaves other columns as they are, and the text rules follow Java's."""
import datetime as dt

from pyspark.sql import functions as F

from orderpulse.functions.text import csv_types, url_ok
from orderpulse.operators.orders import blank
from orderpulse.operators.ratelimit import rate_limit_decisions
from orderpulse.operators.reserve import stock_reservation
from orderpulse.operators.tenancy import register_tenants

BIG = 2 ** 53 + 1


def test_fold_keeps_large_ids_far_timestamps_and_refuses_null_quantities(spark):
    far = dt.datetime(9999, 12, 31, 23, 59, 59)
    rows = [("p", i, None if i % 7 == 3 else BIG + i, far, None if i % 5 == 0 else i % 4, dt.date(9999, 12, 31)) for i in range(200)]
    df = spark.createDataFrame(rows, "product_id string, order_id long, big long, ts timestamp_ntz, quantity int, day date")
    got = {r.order_id: r for r in stock_reservation(df, 100, order=("order_id",), num_partitions=9).collect()}
    stock = 100
    for _, i, big, ts, q, day in rows:
        ok = q is not None and stock >= q
        stock -= q if ok else 0
        r = got[i]
        assert (r.big, r.ts, r.quantity, r.day) == (big, ts, q, day)
        assert (r.status, r.remaining) == ("RESERVED" if ok else "OUT_OF_STOCK", stock)


def test_zero_quantity_in_a_hot_key(spark):
    rows = [("p", i, i % 3) for i in range(900)]
    got = stock_reservation(spark.createDataFrame(rows, "product_id string, order_id long, quantity int"), 50, order=("order_id",), num_partitions=8)
    by = {r.order_id: r.status for r in got.collect()}
    stock = 50
    for _, i, q in rows:
        assert by[i] == ("RESERVED" if stock >= q else "OUT_OF_STOCK")
        stock -= q if stock >= q else 0


def test_probes_are_not_limited(spark):
    rows = [(i, "t", i, i, "LEGACY", "/actuator/health" if i % 2 else "/api") for i in range(300)]
    df = spark.createDataFrame(rows, "request_id long, tenant_id string, req_ms long, ts long, plan string, path string")
    got = rate_limit_decisions(df).collect()
    assert all(r.allowed and r.request_count is None for r in got if r.path.startswith("/act"))
    assert sum(not r.allowed for r in got) == 50


def test_blank_trim_and_url(spark):
    df = spark.createDataFrame([("\t \n", "https://x/a", "order.placed,\n order.completed\t"), ("a", "https://x/a\n", ""), (None, "ftp://x", None)], "b string, u string, c string")
    got = df.select(blank(F.col("b")).alias("b"), url_ok(F.col("u")).alias("u"), csv_types(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, ["order.placed", "order.completed"]), (False, False, [""]), (True, False, None)]


def test_first_valid_request_of_a_slug_is_created(spark):
    req = spark.createDataFrame([(1, "acme", "\t", None), (2, "acme", "Acme", "pro"), (3, "acme", "Other", None)], "request_seq long, slug string, name string, plan string")
    none = spark.createDataFrame([], "slug string")
    assert {r.request_seq: r.outcome for r in register_tenants(req, none).collect()} == {1: "invalid", 2: "created", 3: "conflict"}
