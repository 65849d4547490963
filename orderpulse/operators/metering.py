"""Usage metering per tenant and UTC calendar month (A1-A3), quota checks
(A4, A5) and the usage finders (P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import order_quota, parse_plan, webhook_quota
from .orders import blank

MONTH_KEY = ["tenant_id", "billing_year", "billing_month"]


def month_of(ts: Column) -> list[Column]:
    """year and month of an instant in UTC (the session time zone)."""
    return [F.year(ts).alias("billing_year"), F.month(ts).alias("billing_month")]


def monthly_counts(events: DataFrame, ts_col: str, name: str, weight_col: str | None = None) -> DataFrame:
    """Count events per tenant-month, skipping blank tenants.

    A partial aggregate: each task combines its rows before the shuffle, so
    a tenant holding a third of all rows costs one row per task.  With
    ``weight_col`` each row stands for that many events (input that was
    pre-aggregated before a join).
    """
    e = events.filter(~blank(F.col("tenant_id")))
    agg = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col).cast("bigint")
    return (e.groupBy(F.col("tenant_id"), *month_of(F.col(ts_col))).agg(agg.alias(name)))


def with_plan(usage: DataFrame, tenants: DataFrame | None, default_plan: str = "FREE") -> DataFrame:
    """Attach the plan of each tenant (Q5: from the registry; FREE without one)."""
    if tenants is None:
        return usage.withColumn("plan", F.lit(default_plan))
    t = tenants.select(F.col("id").alias("_tid"), F.col("plan").alias("_plan"))
    j = usage.join(t, usage["tenant_id"] == t["_tid"], "left")
    return j.withColumn("plan", parse_plan(F.coalesce(F.col("_plan"), F.lit(default_plan)))) \
            .drop("_tid", "_plan")


def monthly_usage(orders: DataFrame, tenants: DataFrame | None = None,
                  ts_col: str = "placed_at", weight_col: str | None = None) -> DataFrame:
    """A1: orders per tenant and month -> usage rows (other counters 0)."""
    u = monthly_counts(orders, ts_col, "order_count", weight_col)
    u = u.withColumn("webhook_delivery_count", F.lit(0).cast("bigint")) \
         .withColumn("api_call_count", F.lit(0).cast("bigint"))
    return with_plan(u, tenants)


def monthly_usage_all(orders: DataFrame, deliveries: DataFrame, api_calls: DataFrame,
                      tenants: DataFrame | None = None, weight_col: str | None = None,
                      delivery_weight_col: str | None = None) -> DataFrame:
    """A1-A3: the three counters per tenant-month, missing counters are 0."""
    a = monthly_counts(orders, "placed_at", "order_count", weight_col)
    b = monthly_counts(deliveries, "created_at", "webhook_delivery_count", delivery_weight_col)
    c = monthly_counts(api_calls, "ts", "api_call_count")
    u = a.join(b, MONTH_KEY, "full").join(c, MONTH_KEY, "full")
    u = u.select(*MONTH_KEY, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
                               for n in ("order_count", "webhook_delivery_count", "api_call_count")])
    return with_plan(u, tenants)


def order_quota_check(checks: DataFrame, usage: DataFrame) -> DataFrame:
    """A4: (used, limit, exceeded) per check request.

    The limit is the quota of the *requested* plan; ``exceeded`` compares with
    the quota of the *stored* plan using ``>=``; no usage row gives
    (0, limit, false).
    """
    u = usage.select(*MONTH_KEY, "order_count", F.col("plan").alias("_stored"))
    j = checks.join(u, MONTH_KEY, "left")
    return j.select(*MONTH_KEY, F.col("plan").alias("requested_plan"),
                    F.coalesce(F.col("order_count"), F.lit(0)).cast("bigint").alias("used"),
                    order_quota(parse_plan(F.col("plan"))).alias("quota_limit"),
                    F.coalesce(F.col("order_count") >= order_quota(F.col("_stored")),
                               F.lit(False)).alias("exceeded"))


def webhook_quota_check(usage: DataFrame) -> DataFrame:
    """A5: webhook deliveries against the plan's webhook quota (``>=``)."""
    q = webhook_quota(F.col("plan"))
    return usage.select(*MONTH_KEY, "plan", "webhook_delivery_count", q.alias("webhook_quota"),
                        (F.col("webhook_delivery_count") >= q).alias("exceeded"))


def usage_history(usage: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's usage, newest month first."""
    return (usage.filter(F.col("tenant_id") == tenant_id)
                 .orderBy(F.col("billing_year").desc(), F.col("billing_month").desc()))


def usage_view(usage: DataFrame) -> DataFrame:
    """Usage response with the plan's quota and the exceeded flag."""
    q = order_quota(F.col("plan"))
    return usage.select(*MONTH_KEY, "plan", "order_count", "webhook_delivery_count",
                        "api_call_count", q.alias("order_quota"),
                        (F.col("order_count") >= q).alias("order_quota_exceeded"))
