"""Usage metering, quotas, invoice pricing and the draft/finalize passes."""
import datetime as dt

from pyspark.sql import functions as F

from orderpulse.operators import invoicing as inv
from orderpulse.operators import metering as met
from orderpulse.sources import tables as tb
from conftest import SF001, SF01

EV = "tenant_id string, placed_at timestamp"


def _usage(spark, rows):
    return {(r.tenant_id, r.billing_year, r.billing_month): r.order_count
            for r in met.monthly_usage(spark.createDataFrame(rows, EV)).collect()}


def test_same_tenant_twice_adds(spark):
    t = dt.datetime(2024, 3, 5)
    assert _usage(spark, [("A", t), ("A", t)]) == {("A", 2024, 3): 2}


def test_tenants_and_months_apart_and_blank_skipped(spark):
    rows = [("A", dt.datetime(2024, 3, 1)), ("B", dt.datetime(2024, 3, 1)), ("A", dt.datetime(2024, 4, 1)),
            ("", dt.datetime(2024, 3, 1)), (None, dt.datetime(2024, 3, 1)), ("  ", dt.datetime(2024, 3, 1))]
    assert _usage(spark, rows) == {("A", 2024, 3): 1, ("B", 2024, 3): 1, ("A", 2024, 4): 1}


def test_month_is_utc(spark):
    # 2024-03-31T23:30Z is March in UTC even though it is April in UTC+1
    assert _usage(spark, [("A", dt.datetime(2024, 3, 31, 23, 30))]) == {("A", 2024, 3): 1}


def test_quota_without_record_and_at_limit(spark):
    usage = spark.createDataFrame([("T", 2024, 3, 100, "FREE")],
                                  "tenant_id string, billing_year int, billing_month int, order_count long, plan string")
    checks = spark.createDataFrame([("T", 2024, 3, "free"), ("N", 2024, 3, "PRO")],
                                   "tenant_id string, billing_year int, billing_month int, plan string")
    got = {r.tenant_id: (r.used, r.quota_limit, r.exceeded) for r in met.order_quota_check(checks, usage).collect()}
    assert got == {"T": (100, 100, True), "N": (0, 20000, False)}


def test_invoice_pricing(spark):
    u = spark.createDataFrame([("a", "FREE", 150), ("b", "STARTER", 2000), ("c", "STARTER", 2001),
                               ("d", "PRO", 20005), ("e", "ENTERPRISE", 99999)],
                              "tenant_id string, plan string, order_count long")
    got = {r.t: r.c for r in u.select(F.col("tenant_id").alias("t"),
                                      inv.amount_cents(F.col("plan"), F.col("order_count")).alias("c")).collect()}
    assert got == {"a": 50, "b": 2900, "c": 2901, "d": 9905, "e": 49900}


def _totals(spark, d):
    u = met.monthly_usage(tb.order_lines(spark, d), tb.tenants(spark, d))
    a = inv.invoice_amounts(u).groupBy("tenant_id").agg(F.sum("amount_cents").alias("c"))
    return {r.tenant_id: r.c for r in a.collect()}


def test_invoice_totals_match_fixture(spark):
    assert _totals(spark, SF001) == {"0": 0, "1": 226200, "2": 752400, "3": 3842300, "4": 0}
    assert _totals(spark, SF01) == {"0": 3808, "1": 229100, "2": 782100, "3": 3992000, "4": 3783}


def _inv(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, billing_year int, billing_month int, plan string, "
                                       "order_count long, webhook_delivery_count long, api_call_count long, "
                                       "amount_cents long, status string")


def test_draft_and_finalize_passes(spark):
    usage = spark.createDataFrame(
        [("a", 2024, 5, 150, 0, 0, "FREE"), ("b", 2024, 5, 10, 0, 0, "FREE"), ("c", 2024, 5, 10, 0, 0, "FREE"),
         ("a", 2024, 4, 300, 0, 0, "FREE"), ("d", 2024, 4, 120, 0, 0, "FREE")],
        "tenant_id string, billing_year int, billing_month int, order_count long, "
        "webhook_delivery_count long, api_call_count long, plan string")
    old = _inv(spark, [("a", 2024, 5, "FREE", 1, 0, 0, 0, "DRAFT"), ("b", 2024, 5, "FREE", 1, 0, 0, 0, "PAID"),
                       ("a", 2024, 4, "FREE", 200, 0, 0, 100, "DRAFT")])
    d = {r.tenant_id: (r.order_count, r.amount_cents, r.status)
         for r in inv.draft_invoices(usage, old, 2024, 5).collect()}
    assert d == {"a": (150, 50, "DRAFT"), "b": (1, 0, "PAID"), "c": (10, 0, "DRAFT")}
    f = {r.tenant_id: (r.order_count, r.amount_cents, r.status)
         for r in inv.finalize_invoices(usage, old, *inv.previous_month(2024, 5)).collect()}
    # the stale draft keeps its old counts (Q7); a tenant without invoice is created FINALIZED
    assert f == {"a": (200, 100, "FINALIZED"), "d": (120, 20, "FINALIZED")}
    f2 = {r.tenant_id: r.order_count
          for r in inv.finalize_invoices(usage, old, 2024, 4, refresh=True).collect()}
    assert f2 == {"a": 300, "d": 120}


def test_preaggregated_lines_give_the_same_usage(spark):
    plain = met.monthly_usage(tb.order_lines(spark, SF01), tb.tenants(spark, SF01))
    pre = met.monthly_usage(tb.order_line_counts(spark, SF01), tb.tenants(spark, SF01), weight_col="lines")
    cols = ["tenant_id", "billing_year", "billing_month", "order_count", "plan"]
    assert sorted(map(tuple, plain.select(cols).collect())) == sorted(map(tuple, pre.select(cols).collect()))
    # the pre-aggregated plan joins one row per order, not per line
    plan = pre._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_month_pass_rewrites_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "invoices")
    old = _inv(spark, [("a", 2024, 4, "FREE", 1, 0, 0, 0, "FINALIZED"), ("a", 2024, 5, "FREE", 1, 0, 0, 0, "DRAFT")])
    inv.write_month(old, path)
    usage = spark.createDataFrame([("a", 2024, 5, 150, 0, 0, "FREE")],
                                  "tenant_id string, billing_year int, billing_month int, order_count long, "
                                  "webhook_delivery_count long, api_call_count long, plan string")
    current = spark.read.parquet(path)
    # the pass reads the table it rewrites: materialize its (one-month) result first
    month = inv.draft_invoices(usage, current, 2024, 5).checkpoint(eager=True)
    inv.write_month(month, path)
    got = {(r.billing_month, r.status, r.order_count) for r in spark.read.parquet(path).collect()}
    assert got == {(4, "FINALIZED", 1), (5, "DRAFT", 150)}
