"""Streaming forms of the saga: stock reservation with keyed state (T1), the
payment rule (P1), the stream-stream interval join (J1) and the status feed.

Batch and stream share the rules: ``reserve_scan`` (T1), ``payment_status``
(P1) and ``order_completion`` (J1) are the same functions the batch jobs use.
Results equal the batch results when files arrive in event-time order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

from ..operators.reserve import DEFAULT_STOCK, OUT_OF_STOCK, RESERVED, reserve_scan
from ..operators.saga import completion_columns, order_completion, payment_status

_STOCK_STATE = T.StructType([T.StructField("left", T.IntegerType())])


class StockProcessor(StatefulProcessor):
    """T1 per product: one integer of state (the units left), kept in the
    state store (RocksDB on a cluster) across micro-batches.

    A micro-batch hands over a product's rows in unsorted chunks; they are
    gathered and sorted by event time and id before the fold.  A hot product
    is one key, but its state is a single integer and its rows per batch are
    bounded by the trigger's batch size.
    """

    def __init__(self, initial_stock: int = DEFAULT_STOCK):
        self.initial = int(initial_stock)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", _STOCK_STATE)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["placed_at", "order_id"], kind="stable").reset_index(drop=True)
        left = int(self.stock.get()[0]) if self.stock.exists() else self.initial
        q = pdf["quantity"].to_numpy(dtype=np.int64)
        taken, after = reserve_scan(q, left)
        self.stock.update((int(after),))
        pdf["status"] = np.where(taken, RESERVED, OUT_OF_STOCK)
        pdf["remaining"] = (left - np.cumsum(np.where(taken, q, 0))).astype(np.int32)
        yield pdf

    def close(self) -> None:
        pass


def reserve_stream(orders: DataFrame, initial_stock: int = DEFAULT_STOCK) -> DataFrame:
    """T1 on a stream of orders: each order with status and remaining stock."""
    ship_package(orders.sparkSession)
    out = T.StructType(list(orders.schema.fields) + [T.StructField("status", T.StringType()),
                                                     T.StructField("remaining", T.IntegerType())])
    return orders.groupBy("product_id").transformWithStateInPandas(
        statefulProcessor=StockProcessor(initial_stock), outputStructType=out,
        outputMode="Append", timeMode="None")


def saga_stream(orders: DataFrame, initial_stock: int = DEFAULT_STOCK) -> DataFrame:
    """P1 + T1 + J1 in one streaming query: both facts of an order carry its
    event time, so the +-5 minute join condition always holds and the payment
    rule is applied to the reservation row (no stream-stream join state)."""
    r = reserve_stream(orders, initial_stock)
    pay = payment_status(F.col("amount"))
    status, reason = completion_columns(pay, F.col("status"))
    return r.select("order_id", status.alias("status"), reason.alias("reason"),
                    F.col("placed_at").alias("completed_at"), "correlation_id", "tenant_id",
                    pay.alias("payment_status"), F.col("status").alias("inventory_status"))


def completion_stream(payments: DataFrame, reserved: DataFrame, delay: str = "5 minutes",
                      window: str = "5 minutes") -> DataFrame:
    """J1 between two fact streams: watermarks on both event times bound the
    join state.  Once a micro-batch has run under a watermark, partners older
    than it are evicted, so a fact arriving later completes nothing - the
    reference's no-grace window.  (Spark still joins a late fact with a
    partner that is in state in the same batch; it only promises never to
    drop facts within the delay.)"""
    p = payments.withWatermark("processed_at", delay)
    i = reserved.withWatermark("reserved_at", delay)
    return order_completion(p, i, window)
