"""The order saga: payment decision (P1), stock reservation (T1), the interval
join of both facts into a final status (J1), the status projection onto the
orders table (J2) and the per-customer completion feed (J3)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import deterministic_id
from .ranking import global_running_max
from .reserve import RESERVED, reservations, stock_reservation

# Fixed values of the payment rule: amounts strictly above this are declined.
PAYMENT_LIMIT = Decimal("1000.00")
APPROVED, DECLINED = "APPROVED", "DECLINED"
CONFIRMED, REJECTED = "CONFIRMED", "REJECTED"
REASON_PAYMENT, REASON_STOCK = "payment_declined", "out_of_stock"
JOIN_WINDOW = "5 minutes"


def payment_status(amount: Column, limit: Decimal = PAYMENT_LIMIT) -> Column:
    """P1 rule as a column: DECLINED when amount > limit, else APPROVED."""
    return F.when(amount > F.lit(limit).cast("decimal(12,2)"), F.lit(DECLINED)).otherwise(F.lit(APPROVED))


def payment_decision(orders: DataFrame, limit: Decimal = PAYMENT_LIMIT) -> DataFrame:
    """One ``payments.processed`` record per order (a narrow projection, no shuffle)."""
    return orders.select(
        "order_id",
        deterministic_id(F.lit("payment"), F.col("order_id")).alias("payment_id"),
        payment_status(F.col("amount"), limit).alias("status"),
        "amount",
        F.col("placed_at").alias("processed_at"),
        "correlation_id", "tenant_id",
    )


def completion_columns(pay_status: Column, inv_status: Column) -> tuple[Column, Column]:
    ok = (pay_status == APPROVED) & (inv_status == RESERVED)
    status = F.when(ok, F.lit(CONFIRMED)).otherwise(F.lit(REJECTED))
    reason = (F.when(ok, F.lit(None).cast("string"))
               .when(pay_status != APPROVED, F.lit(REASON_PAYMENT))
               .otherwise(F.lit(REASON_STOCK)))
    return status, reason


def order_completion(payments: DataFrame, reserved: DataFrame,
                     window: str = JOIN_WINDOW) -> DataFrame:
    """Interval join of payments and reservations on order id within +-window.

    CONFIRMED iff APPROVED and RESERVED; ``payment_declined`` wins over
    ``out_of_stock``; correlation and tenant come from the payment.  Both sides
    are hash-partitioned on ``order_id`` (the equi part); the time bound is a
    join condition, so Spark plans a sort-merge join with a range filter and,
    on streams, uses it to evict state behind the watermark.
    """
    p = payments.alias("p")
    i = reserved.alias("i")
    cond = (F.col("p.order_id") == F.col("i.order_id")) & F.expr(
        f"i.reserved_at BETWEEN p.processed_at - INTERVAL {window} "
        f"AND p.processed_at + INTERVAL {window}")
    status, reason = completion_columns(F.col("p.status"), F.col("i.status"))
    return p.join(i, cond, "inner").select(
        F.col("p.order_id").alias("order_id"),
        status.alias("status"),
        reason.alias("reason"),
        F.greatest(F.col("p.processed_at"), F.col("i.reserved_at")).alias("completed_at"),
        F.col("p.correlation_id").alias("correlation_id"),
        F.col("p.tenant_id").alias("tenant_id"),
        F.col("p.status").alias("payment_status"),
        F.col("i.status").alias("inventory_status"),
    )


PAYMENT_FACT, RESERVED_FACT = "payment", "reservation"
FACT_ORDER = ["arrived_at", "side", "order_id"]


def arriving_facts(payments: DataFrame, reserved: DataFrame) -> DataFrame:
    """Both topics as one stream of facts (``arrived_at`` on either side), in arrival order with their own time."""
    p = payments.select("order_id", F.lit(PAYMENT_FACT).alias("side"), F.col("processed_at").alias("at"), "arrived_at",
                        "status", "correlation_id", "tenant_id")
    r = reserved.select("order_id", F.lit(RESERVED_FACT).alias("side"), F.col("reserved_at").alias("at"), "arrived_at",
                        "status", "correlation_id", "tenant_id")
    return p.unionByName(r)


def on_time(facts: DataFrame, stream_time: Column | None = None, window: str = JOIN_WINDOW,
            num_partitions: int | None = None) -> DataFrame:
    """J1 without grace: the facts that may complete an order, with the stream time at their arrival.

    Stream time is the greatest event time that has arrived so far, on either side, and at least ``stream_time``.
    A fact older than stream time by more than the window is late and completes nothing."""
    seen = global_running_max(facts, FACT_ORDER, "at", "stream_time", num_partitions)
    if stream_time is not None:
        seen = seen.withColumn("stream_time", F.greatest("stream_time", stream_time))
    return seen.filter(F.col("at") >= F.col("stream_time") - F.expr(f"INTERVAL {window}"))


def complete_facts(facts: DataFrame, window: str = JOIN_WINDOW) -> DataFrame:
    """The completions of facts that are all on time."""
    p = facts.filter(F.col("side") == PAYMENT_FACT).withColumnRenamed("at", "processed_at")
    r = facts.filter(F.col("side") == RESERVED_FACT).withColumnRenamed("at", "reserved_at")
    return order_completion(p, r, window)


def completion_no_grace(payments: DataFrame, reserved: DataFrame, window: str = JOIN_WINDOW,
                        num_partitions: int | None = None) -> DataFrame:
    """J1 as the facts arrive: late ones complete nothing."""
    return complete_facts(on_time(arriving_facts(payments, reserved), None, window, num_partitions), window)


def saga(orders: DataFrame, initial_stock: int = 100, num_partitions: int | None = None) -> DataFrame:
    """Whole saga on one order table: P1 -> T1 -> J1, the interval join included."""
    reserved = reservations(orders, initial_stock=initial_stock, num_partitions=num_partitions)
    return order_completion(payment_decision(orders), reserved)


def saga_summary(completions: DataFrame) -> DataFrame:
    """Counts by final status and reason (a two-phase, map-side combined aggregate)."""
    return (completions.groupBy("status", "reason")
            .agg(F.count(F.lit(1)).alias("n_orders")))


def order_status(orders: DataFrame, completions: DataFrame) -> DataFrame:
    """Project completions onto the orders table.

    The latest completion per order wins (no guard on the previous status);
    completions for unknown orders are ignored; orders without one stay PLACED.
    ``max_by`` is a partial aggregate, so duplicates collapse map-side.
    """
    seq = F.struct(F.col("completed_at"), F.col("correlation_id"))
    latest = (completions.groupBy("order_id")
              .agg(F.max_by("status", seq).alias("final_status"),
                   F.max_by("completed_at", seq).alias("updated_at")))
    o = orders.alias("o")
    return (o.join(latest.alias("c"), "order_id", "left")
            .select("order_id", "tenant_id", "customer_id", "product_id", "quantity", "amount",
                    F.coalesce(F.col("final_status"), F.lit("PLACED")).alias("status"),
                    F.coalesce(F.col("updated_at"), F.col("placed_at")).alias("updated_at")))


def customer_feed(completions: DataFrame, orders: DataFrame) -> DataFrame:
    """Route each completion to the customer who placed the order.

    Completions whose order is unknown are dropped (inner join).  Unlike the
    reference's live feed, confirmed orders (null reason) are kept.
    """
    o = orders.select("order_id", "customer_id")
    return completions.join(o, "order_id", "inner").select(
        "customer_id", "order_id", "status", "reason", "completed_at", "tenant_id")


__all__ = ["payment_decision", "order_completion", "saga", "saga_summary", "order_status",
           "customer_feed", "reservations", "stock_reservation"]
