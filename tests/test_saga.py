"""Saga: payment rule, stock reservation, interval join (FIXTURES.md C and the boundary cases)."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderpulse.operators import saga as sg
from orderpulse.operators.reserve import stock_reservation
from orderpulse.sources import tables as tb
from conftest import SF001, SF01


def _orders(spark, rows):
    schema = ("order_id string, customer_id string, product_id string, quantity int, "
              "amount decimal(12,2), currency string, placed_at timestamp, correlation_id string, "
              "tenant_id string")
    return spark.createDataFrame(rows, schema)


def _row(i, product, qty, amount):
    t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)
    return (f"o{i}", "c1", product, qty, Decimal(amount), "USD", t, f"c{i}", "t1")


def test_payment_boundary(spark):
    o = _orders(spark, [_row(1, "p", 1, "1000.00"), _row(2, "p", 1, "1000.01")])
    got = {r.order_id: r.status for r in sg.payment_decision(o).collect()}
    assert got == {"o1": "APPROVED", "o2": "DECLINED"}


def test_reservation_boundary_later_smaller_order_passes(spark):
    o = _orders(spark, [_row(1, "p", 60, "1"), _row(2, "p", 60, "1"), _row(3, "p", 40, "1")])
    got = {r.order_id: (r.status, r.remaining) for r in stock_reservation(o).collect()}
    assert got == {"o1": ("RESERVED", 40), "o2": ("OUT_OF_STOCK", 40), "o3": ("RESERVED", 0)}


def test_declined_payment_keeps_reserved_stock(spark):
    o = _orders(spark, [_row(1, "p", 100, "5000"), _row(2, "p", 1, "1")])
    got = {r.order_id: (r.status, r.reason, r.inventory_status) for r in sg.saga(o).collect()}
    assert got["o1"] == ("REJECTED", "payment_declined", "RESERVED")
    assert got["o2"] == ("REJECTED", "out_of_stock", "OUT_OF_STOCK")


def _summary(df):
    return {(r.status, r.reason): r.n_orders for r in sg.saga_summary(df).collect()}


def test_saga_counts_sf001(spark):
    s = _summary(sg.saga(tb.orders_stream(spark, SF001)))
    assert s == {("CONFIRMED", None): 864, ("REJECTED", "payment_declined"): 136}


def test_saga_counts_sf01_fused_and_joined_agree(spark):
    o = tb.orders_stream(spark, SF01)
    expected = {("CONFIRMED", None): 2975, ("REJECTED", "out_of_stock"): 5709,
                ("REJECTED", "payment_declined"): 1316}
    assert _summary(sg.saga(o)) == expected
    joined = sg.order_completion(sg.payment_decision(o), sg.reservations(o))
    assert _summary(joined) == expected


def test_saga_runs_the_interval_join(spark, monkeypatch):
    o = _orders(spark, [_row(1, "p", 1, "1"), _row(2, "p", 1, "1")])
    late = F.when(F.col("order_id") == "o2", F.col("reserved_at") + F.expr("INTERVAL 6 MINUTES")).otherwise(F.col("reserved_at"))
    plain = sg.reservations
    monkeypatch.setattr(sg, "reservations", lambda *a, **kw: plain(*a, **kw).withColumn("reserved_at", late))
    assert [r.order_id for r in sg.saga(o).collect()] == ["o1"]


def test_reservation_counts_sf01(spark):
    r = stock_reservation(tb.orders_stream(spark, SF01))
    got = {x.status: x["count"] for x in r.groupBy("status").count().collect()}
    assert got == {"RESERVED": 3400, "OUT_OF_STOCK": 6600}


def test_interval_join_drops_facts_outside_window(spark):
    o = _orders(spark, [_row(1, "p", 1, "1"), _row(2, "p", 1, "1")])
    pay = sg.payment_decision(o)
    res = sg.reservations(o).withColumn(
        "reserved_at", F.when(F.col("order_id") == "o2", F.col("reserved_at") + F.expr("INTERVAL 6 MINUTES"))
        .otherwise(F.col("reserved_at")))
    got = [r.order_id for r in sg.order_completion(pay, res).collect()]
    assert got == ["o1"]


def test_status_projection_last_event_wins(spark):
    o = _orders(spark, [_row(1, "p", 1, "1"), _row(2, "p", 1, "1")])
    t0 = dt.datetime(2024, 1, 2)
    comp = spark.createDataFrame(
        [("o1", "CONFIRMED", t0, "x"), ("o1", "REJECTED", t0 + dt.timedelta(seconds=1), "y"),
         ("zz", "CONFIRMED", t0, "z")],
        "order_id string, status string, completed_at timestamp, correlation_id string")
    got = {r.order_id: r.status for r in sg.order_status(o, comp).collect()}
    assert got == {"o1": "REJECTED", "o2": "PLACED"}
