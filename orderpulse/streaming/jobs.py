"""Streaming sinks: metering (A1) as idempotent per-batch deltas, orders per
minute (A9) with a watermark, the outbox relay (S7) and topic routing for
retries and dead letters (T7).

``foreachBatch`` writers key their output by the batch id: a retried batch
overwrites its own directory instead of adding twice, so the sinks are
exactly-once on top of the checkpoint (X1); metering and placed orders are committed
per batch (``committed``).  Metering itself is at-least-once
per message in the reference (X3); ``dedup=True`` removes redelivered orders
within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metering import MONTH_KEY, monthly_counts
from ..operators.metrics import orders_per_minute
from ..operators.outbox import decoded_order_id
from .committed import BATCH, CommittedTables, summed


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


#: The default trigger of the jobs that run on: a micro-batch each second.
INTERVAL = "1 second"


def triggered(writer, available_now: bool, interval: str):
    """All input that is there and then stop, or a micro-batch each ``interval``."""
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def metering_stream(orders: DataFrame, deltas_root: str, checkpoint: str, dedup: bool = False,
                    delay: str = "10 minutes", available_now: bool = True, interval: str = INTERVAL):
    """A1 on a stream: each micro-batch commits its tenant-month counts to the table ``usage``
    under ``deltas_root`` (a replay adds nothing).  The usage table is :func:`usage_from_deltas`."""
    src = orders
    if dedup:
        src = src.withWatermark("placed_at", delay).dropDuplicatesWithinWatermark(["order_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = monthly_counts(batch, "placed_at", "order_count")
        CommittedTables(batch.sparkSession, deltas_root).commit(batch_id, {"usage": counts})

    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()


def usage_from_deltas(spark, deltas_root: str) -> DataFrame:
    """The usage table: the sum of all committed deltas per tenant-month."""
    d = CommittedTables(spark, deltas_root).read("usage")
    if d is None:
        raise ValueError(f"no batch is committed under {deltas_root}")
    return d.groupBy(*MONTH_KEY).agg(F.sum("order_count").alias("order_count"))


def compact_usage(spark, deltas_root: str) -> int | None:
    """Merge the committed deltas to one row per tenant-month; the last batch they hold."""
    return CommittedTables(spark, deltas_root).compact("usage", summed(tuple(MONTH_KEY)))


def orders_per_minute_stream(orders: DataFrame, delay: str = "1 minute") -> DataFrame:
    """A9 on a stream: sliding-window counts, emitted once the watermark passes."""
    return orders_per_minute(orders.withWatermark("placed_at", delay))


def relay_stream(outbox: DataFrame, topics_root: str, checkpoint: str, available_now: bool = True, interval: str = INTERVAL,
                 failed_root: str | None = None):
    """S7 on a stream of outbox rows: publish each unprocessed row to the topic
    its ``topic`` column names (one directory per topic), keyed per batch.  A row whose payload does
    not decode (S6) is a failed attempt: it is not published, and goes to ``failed_root`` when given."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col("processed_at").isNull())
        good = decoded_order_id(F.col("payload")).isNotNull()
        if failed_root:
            rows.filter(~good).write.mode("overwrite").parquet(_batch_dir(failed_root, batch_id))
        (rows.filter(good).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").partitionBy("topic")
             .parquet(_batch_dir(topics_root, batch_id)))

    w = outbox.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()


def route_outcomes(batch: DataFrame, root: str, batch_id: int, ok: str = "ok",
                   retry: str = "retry", dead: str = "dead", outcome_col: str = "outcome") -> None:
    """T7 sink: split one batch into ok / retry / dead tables by outcome."""
    for name in (ok, retry, dead):
        (batch.filter(F.col(outcome_col) == name)
              .write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch_id={batch_id}"))


def place_orders_stream(requests: DataFrame, root: str, checkpoint: str,
                        available_now: bool = True, interval: str = INTERVAL):
    """S5 on a stream: each batch commits its accepted orders *and* their outbox rows as the tables ``orders``
    and ``outbox`` under ``root``, so readers see both or neither (:func:`placed`)."""
    from ..operators.orders import place_orders

    def write(batch: DataFrame, batch_id: int) -> None:
        orders, outbox = place_orders(batch.persist())
        CommittedTables(batch.sparkSession, root).commit(batch_id, {"orders": orders, "outbox": outbox})
        batch.unpersist()

    w = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()


def placed(spark, root: str, name: str) -> DataFrame | None:
    """The committed rows of ``orders`` or ``outbox``; None before the first commit."""
    rows = CommittedTables(spark, root).read(name)
    return None if rows is None else rows.drop(BATCH)


def order_status_stream(completions: DataFrame, deltas_root: str, checkpoint: str,
                        available_now: bool = True, interval: str = INTERVAL):
    """J2 on a stream: each batch writes the latest completion per order it saw."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seq = F.struct("completed_at", "correlation_id")
        latest = batch.groupBy("order_id").agg(F.max_by("status", seq).alias("status"),
                                               F.max("completed_at").alias("completed_at"))
        latest.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
              .parquet(_batch_dir(deltas_root, batch_id))

    w = completions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()


def order_status_from_deltas(spark, orders: DataFrame, deltas_root: str) -> DataFrame:
    """The orders table with the latest streamed status (PLACED when none)."""
    d = spark.read.parquet(deltas_root)
    latest = d.groupBy("order_id").agg(
        F.max_by("status", F.struct("completed_at", "batch_id")).alias("final_status"))
    return (orders.join(latest, "order_id", "left")
                  .withColumn("status", F.coalesce(F.col("final_status"), F.lit("PLACED")))
                  .drop("final_status"))
