"""T7 as a stream: a consumer whose failed records wait in keyed state for their next attempt.

Every delivery of a topic comes in with the error that its handler raised (null: none).  A record that fails
is held with the time of its next attempt; a timer brings it back, and each attempt is one row of the output with
the topic it was read from.  After the last attempt, or at once for a fatal error, a row for the dead-letter
topic follows.  ``fails`` tells how many attempts of a record fail (null: all of them), so a record can recover.

Timers run on event time, so a replay gives the same rows; the attempts that the watermark has passed are made at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.retries import RetryPolicy
from ..session import ship_package
from .jobs import INTERVAL, triggered

OK, RETRY, DEAD = "ok", "retry", "dead"
_HELD = "error_class string, fails int, attempt int, due_ms long, waited_ms long"
OUTPUT = ("record_id string, error_class string, attempt int, delay_ms long, waited_ms long, "
          "at_ms long, topic string, outcome string")


class RetryProcessor(StatefulProcessor):
    """A list of the record's waiting deliveries; one timer for each due time."""

    def __init__(self, policy: RetryPolicy, topic: str):
        self.policy, self.topic = policy, topic

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def _wait(self, attempt: int) -> int:
        """Milliseconds before an attempt."""
        p = self.policy
        return 0 if attempt == 1 else int(min(float(p.max_ms), p.initial_ms * p.multiplier ** (attempt - 2)))

    def _topic(self, attempt: int) -> str:
        suffix = self.policy.retry_topic_suffix
        return self.topic if attempt == 1 or not suffix else f"{self.topic}{suffix}{attempt - 2}"

    def _attempts(self, record: str, error: str | None, fails: int, attempt: int, due: int, waited: int, now: int, out: list) -> tuple | None:
        """Make the attempts that are due by ``now``; what then waits, or None."""
        while due <= now:
            good = error is None or attempt > fails
            last = not good and (error in self.policy.fatal or attempt == self.policy.attempts)
            out.append((record, error, attempt, self._wait(attempt), waited, due, self._topic(attempt), OK if good else RETRY))
            if last:
                out.append((record, error, attempt, 0, waited, due, self.topic + self.policy.dlt_suffix, DEAD))
            if good or last:
                return None
            attempt += 1
            due, waited = due + self._wait(attempt), waited + self._wait(attempt)
        return (error, fails, attempt, due, waited)

    def _emit(self, record: str, started: list, now: int):
        """Run deliveries as far as ``now`` lets them, keep the rest, and put out the attempts."""
        out, rest = [], []
        for s in started:
            by = max(now, s[3]) if s[2] == 1 else now   # the first attempt is made when the record comes in
            if (left := self._attempts(record, *s, by, out)) is not None:
                rest.append(left)
        for r in rest:
            self.handle.registerTimer(r[3])
        return out, rest

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for pdf in rows:
            for error, fails, at in zip(pdf["error_class"], pdf["fails"], pdf["at_ms"]):
                error = None if pd.isna(error) else str(error)
                new.append((error, self.policy.attempts if pd.isna(fails) else int(fails), 1, int(at), 0))
        out, rest = self._emit(key[0], sorted(new, key=lambda r: r[3]), timerValues.getCurrentWatermarkInMs())
        if rest:
            self.held.appendList(rest)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = [r for r in held if r[3] <= now]
        out, rest = self._emit(key[0], due, now)
        keep = [r for r in held if r[3] > now] + rest
        if keep:
            self.held.put(keep)
        else:
            self.held.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"attempt": "int32", "delay_ms": "int64", "waited_ms": "int64", "at_ms": "int64"})


def retry_stream(deliveries: DataFrame, policy: RetryPolicy, topic: str, delay: str = "0 seconds", id_col: str = "record_id",
                 error_col: str = "error_class", time_col: str = "at", fails_col: str | None = None) -> DataFrame:
    """Every attempt of every delivery of ``topic`` (``OUTPUT``), and a row for each dead letter."""
    ship_package(deliveries.sparkSession)
    fails = F.col(fails_col).cast("int") if fails_col else F.lit(None).cast("int")
    d = deliveries.withWatermark(time_col, delay)
    d = d.select(F.col(id_col).cast("string").alias("record_id"), F.col(error_col).cast("string").alias("error_class"), fails.alias("fails"),
                 F.unix_millis(time_col).alias("at_ms"), F.col(time_col))
    return d.groupBy("record_id").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(policy, topic), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def retry_topics(attempts: DataFrame, root: str, checkpoint: str, available_now: bool = True, interval: str = INTERVAL):
    """Write the attempts of ``retry_stream`` to their topics, committed per batch: ``attempts`` by topic, and ``dead``."""
    from .committed import CommittedTables

    spark = attempts.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        dead = F.col("outcome") == DEAD
        CommittedTables(spark, root).commit(batch_id, {"attempts": batch.filter(~dead), "dead": batch.filter(dead)})
        batch.unpersist()

    w = attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()
