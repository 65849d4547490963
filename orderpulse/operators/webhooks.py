"""Webhook fan-out: the event bodies of the three listeners merged into one
table (P20, U1, F4, F5), subscriptions (F3), the fan-out to active endpoints
(J5) and payload signing (F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hmac import hmac_sha256_hex, key_pads
from ..functions.ids import deterministic_id
from ..functions.text import csv_types, iso_instant
from .saga import CONFIRMED, DECLINED

EVENT_COLS = ["tenant_id", "event_type", "event_id", "payload", "event_time"]

# The webhook body templates of the three listeners (text, no escaping).
PLACED_BODY = ('{"event":"order.placed","orderId":"%s","customerId":"%s","productId":"%s",'
               '"quantity":%d,"currency":"%s","tenantId":"%s","placedAt":"%s"}')
PAYMENT_FAILED_BODY = '{"event":"payment.failed","orderId":"%s","paymentId":"%s","tenantId":"%s","processedAt":"%s"}'
COMPLETED_BODY = '{"event":"%s","orderId":"%s","status":"%s","tenantId":"%s","completedAt":"%s"}'


def placed_events(orders: DataFrame) -> DataFrame:
    """``order.placed`` bodies (text template, no escaping: Q15)."""
    body = F.format_string(
        PLACED_BODY, "order_id", "customer_id", "product_id", "quantity", "currency", "tenant_id",
        iso_instant(F.col("placed_at")))
    return orders.select("tenant_id", F.lit("order.placed").alias("event_type"),
                         F.col("order_id").alias("event_id"), body.alias("payload"),
                         F.col("placed_at").alias("event_time"))


def payment_failed_events(payments: DataFrame) -> DataFrame:
    """``payment.failed`` bodies, DECLINED payments only."""
    body = F.format_string(
        PAYMENT_FAILED_BODY, "order_id", "payment_id", "tenant_id", iso_instant(F.col("processed_at")))
    return payments.filter(F.col("status") == DECLINED).select(
        "tenant_id", F.lit("payment.failed").alias("event_type"), F.col("order_id").alias("event_id"),
        body.alias("payload"), F.col("processed_at").alias("event_time"))


def completed_events(completions: DataFrame) -> DataFrame:
    """``order.completed`` / ``order.rejected`` bodies by final status."""
    et = F.when(F.col("status") == CONFIRMED, F.lit("order.completed")).otherwise(F.lit("order.rejected"))
    body = F.format_string(
        COMPLETED_BODY, et, F.col("order_id"), F.col("status"), F.col("tenant_id"), iso_instant(F.col("completed_at")))
    return completions.select("tenant_id", et.alias("event_type"), F.col("order_id").alias("event_id"),
                              body.alias("payload"), F.col("completed_at").alias("event_time"))


def webhook_events(orders: DataFrame, payments: DataFrame, completions: DataFrame) -> DataFrame:
    """The three event streams as one table (a union, no shuffle)."""
    return (placed_events(orders).unionByName(payment_failed_events(payments))
            .unionByName(completed_events(completions)))


def subscriptions(endpoints: DataFrame) -> DataFrame:
    """one row per ACTIVE endpoint and distinct trimmed event type.

    ``array_distinct`` makes a repeated CSV entry subscribe once, as the
    reference's membership test does.
    """
    e = endpoints.filter(F.col("status") == "ACTIVE")
    return e.select(F.col("id").alias("endpoint_id"), "tenant_id",
                    F.explode(F.array_distinct(csv_types(F.col("event_types")))).alias("event_type"))


def webhook_fanout(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One PENDING delivery per (event, subscribed active endpoint of its tenant).

    An equi-join on (tenant_id, event_type).  The subscription side grows
    with endpoints, not with events; the planner broadcasts it when AQE
    measures it small, otherwise both sides shuffle and AQE splits a hot
    tenant's partition (skew join).
    """
    s = subscriptions(endpoints)
    j = events.join(s, ["tenant_id", "event_type"], "inner")
    return j.select(
        deterministic_id(F.col("endpoint_id"), F.col("event_type"), F.col("event_id")).alias("delivery_id"),
        "endpoint_id", "tenant_id", "event_type", "event_id", "payload",
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"),
        F.col("event_time").alias("created_at"))


def fanout_counts(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A2: deliveries of ``webhook_fanout`` per (tenant, event type, UTC month), without its rows.

    Events and subscriptions are counted on the join key first (partial aggregates), and the
    counts multiplied; ``created_at`` is the start of the month.
    """
    month = F.date_trunc("month", F.col("event_time"))
    e = events.groupBy("tenant_id", "event_type", month.alias("created_at")).agg(F.count(F.lit(1)).alias("_events"))
    s = subscriptions(endpoints).groupBy("tenant_id", "event_type").agg(F.count(F.lit(1)).alias("_subscribers"))
    return e.join(s, ["tenant_id", "event_type"]).select(
        "tenant_id", "event_type", "created_at", (F.col("_events") * F.col("_subscribers")).alias("deliveries"))


def sign_payloads(deliveries: DataFrame, endpoints: DataFrame) -> DataFrame:
    """F1 in bulk: the signature header for every delivery.

    The HMAC pads are computed on the endpoint table (once per endpoint) and
    joined to the deliveries; per delivery only the two SHA-256 passes run.
    """
    ipad, opad = key_pads(F.col("secret"))
    pads = endpoints.select(F.col("id").alias("endpoint_id"), ipad.alias("_ipad"), opad.alias("_opad"))
    j = deliveries.join(pads, "endpoint_id", "inner")
    sig = F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("_ipad"), F.col("_opad"), F.col("payload")))
    return j.select("delivery_id", "endpoint_id", "event_type", sig.alias("signature"))
