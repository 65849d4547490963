"""J1 on streams without grace: what is late completes nothing, however the stream is cut into batches.

Stream time is kept by the arrival of facts, not by the batch: a fact is late if the facts that arrived before it have
moved the greatest event time beyond it by more than the window.  The facts that are on time and may still meet a partner
(a repeated fact meets it again, as in the batch join) are carried from batch to batch, with the stream time, in tables that are committed together with the completions.
Only facts within two windows of the stream time are carried, so the state is bounded by the rate of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.saga import JOIN_WINDOW, PAYMENT_FACT, complete_facts, on_time
from .committed import BATCH, CommittedTables
from .jobs import INTERVAL, triggered


def _last(tables: CommittedTables, name: str, batch_id: int) -> DataFrame | None:
    """The rows that the batch before ``batch_id`` left."""
    done = [b for b in tables.batches() if b < batch_id]
    rows = tables.read(name, batch_id)
    return None if rows is None else rows.where(F.col(BATCH) == done[-1]).drop(BATCH)


def complete_batch(facts: DataFrame, pending: DataFrame | None, clock: DataFrame | None, window: str = JOIN_WINDOW,
                   num_partitions: int | None = None) -> dict[str, DataFrame]:
    """The tables of one batch: its completions, the facts that wait on, and the stream time at its end."""
    before = None if clock is None else F.lit(clock.first().stream_time)   # one row
    fresh = on_time(facts, before, window, num_partitions).drop("stream_time").checkpoint(eager=True)
    every = fresh if pending is None else fresh.unionByName(pending)
    payment = F.col("side") == PAYMENT_FACT
    # a completion is made in the batch that brings the later of its two facts
    done = complete_facts(fresh.where(payment).unionByName(every.where(~payment)), window)
    if pending is not None:
        done = done.unionByName(complete_facts(pending.where(payment).unionByName(fresh.where(~payment)), window))
    end = facts.agg(F.max("at").alias("stream_time"))
    end = end.select(F.greatest("stream_time", before).alias("stream_time")) if before is not None else end
    at_end = F.lit(end.first().stream_time)
    waiting = every.where(F.col("at") >= at_end - F.expr(f"INTERVAL {window}") - F.expr(f"INTERVAL {window}"))
    return {"completions": done, "pending": waiting, "clock": facts.sparkSession.range(1).select(at_end.alias("stream_time"))}


def completion_no_grace_stream(facts: DataFrame, root: str, checkpoint: str, window: str = JOIN_WINDOW, num_partitions: int | None = None,
                               available_now: bool = True, interval: str = INTERVAL):
    """Complete a stream of ``arriving_facts`` into the committed table ``completions`` under ``root``."""
    spark: SparkSession = facts.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = CommittedTables(spark, root)
        if batch_id in tables.batches() or batch.isEmpty():
            return
        made = complete_batch(batch, _last(tables, "pending", batch_id), _last(tables, "clock", batch_id), window, num_partitions)
        tables.commit(batch_id, made)

    w = facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()
