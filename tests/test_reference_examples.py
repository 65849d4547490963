"""Remaining examples of the reference's own tests, as small frames."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderpulse.functions.text import url_ok
from orderpulse.operators import metering as met
from orderpulse.operators import orders as ords

T = dt.datetime(2024, 3, 5)


def test_webhook_deliveries_count_separately_from_orders(spark):
    none_orders = spark.createDataFrame([], "tenant_id string, placed_at timestamp")
    deliveries = spark.createDataFrame([("tenant-D", T), ("tenant-D", T)], "tenant_id string, created_at timestamp")
    calls = spark.createDataFrame([], "tenant_id string, ts timestamp")
    tenants = spark.createDataFrame([("tenant-D", "PRO")], "id string, plan string")
    r = met.monthly_usage_all(none_orders, deliveries, calls, tenants).first()
    assert (r.webhook_delivery_count, r.order_count, r.api_call_count, r.plan) == (2, 0, 0, "PRO")


def test_usage_rows_per_tenant(spark):
    ev = spark.createDataFrame([("tenant-1", T)] + [("tenant-2", T)] * 5, "tenant_id string, placed_at timestamp")
    tenants = spark.createDataFrame([("tenant-1", "STARTER"), ("tenant-2", "PRO")], "id string, plan string")
    got = {r.tenant_id: (r.plan, r.order_count) for r in met.monthly_usage(ev, tenants).collect()}
    assert got == {"tenant-1": ("STARTER", 1), "tenant-2": ("PRO", 5)}


def test_order_request_validation(spark):
    schema = ("order_id string, tenant_id string, customer_id string, product_id string, quantity int, "
              "amount decimal(12,2), currency string")
    req = spark.createDataFrame([("a", "test-tenant", "cust", "prod-001", 2, Decimal("19.99"), "USD"),
                                 ("b", "test-tenant", "cust", "", 2, Decimal("19.99"), "USD")], schema)
    got = {r.order_id: (r.valid, r.failed) for r in ords.validate_orders(req).collect()}
    assert got == {"a": (True, ""), "b": (False, "product_id_blank")}


def test_endpoint_request_rules(spark):
    df = spark.createDataFrame([("https://example.com/hook", "s" * 16), ("not-a-url", "s" * 16),
                                ("https://example.com/hook", "short")], "url string, secret string")
    rules = [("url_pattern", ~url_ok(F.col("url"))), ("secret_too_short", F.length("secret") < 16)]
    got = [r.failed for r in ords.validate(df, rules).collect()]
    assert got == ["", "url_pattern", "secret_too_short"]
