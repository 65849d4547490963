"""Retry ladders and dead letters (T7) and the poison-message split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int            # total deliveries including the first
    initial_ms: int          # wait before the second attempt
    multiplier: float
    max_ms: int
    dlt_suffix: str
    retry_topic_suffix: str | None = None   # retry topics "-retry-<i>" when set
    fatal: tuple[str, ...] = ()             # error classes that skip the retries


# The two retry settings of the reference.
NOTIFICATION = RetryPolicy(attempts=4, initial_ms=1000, multiplier=2.0, max_ms=30_000,
                           dlt_suffix="-dlt", retry_topic_suffix="-retry-")
ORDER_LISTENER = RetryPolicy(attempts=6, initial_ms=500, multiplier=2.0, max_ms=30_000,
                             dlt_suffix=".DLT",
                             fatal=("SerializationException", "IllegalArgumentException",
                                    "IllegalStateException"))


def poison_split(df: DataFrame, rule: Column | None = None, id_col: str = "order_id") -> DataFrame:
    """Flag records the consumer will fail on (default: id starts with ``fail``)."""
    r = rule if rule is not None else F.col(id_col).startswith("fail")
    return df.withColumn("poison", F.coalesce(r, F.lit(False)))


def _attempts(policy: RetryPolicy, error_col: str, fails_col: str | None) -> tuple[Column, Column]:
    """Deliveries of a failing record and whether the last one fails too.  ``fails_col`` tells how many fail
    (null: all); a record whose error is fatal has no second one."""
    fatal = F.coalesce(F.col(error_col).isin(*policy.fatal), F.lit(False)) if policy.fatal else F.lit(False)
    most = F.when(fatal, F.lit(1)).otherwise(F.lit(policy.attempts))
    if fails_col is None:
        return most, F.lit(True)
    fails = F.coalesce(F.col(fails_col), most)
    return F.least(most, fails + 1), fails >= most


def retry_schedule(failures: DataFrame, policy: RetryPolicy, topic: str, id_col: str = "record_id",
                   error_col: str = "error_class", fails_col: str | None = None) -> DataFrame:
    """One row per delivery attempt of every failing record.

    ``delay_ms`` is the wait before the attempt, ``least(max, d0 * m^(k-2))``
    for attempt k >= 2; fatal error classes get only the first attempt.  The
    ``topic`` column names where the attempt reads from (retry topics for the
    notification policy) - a writer partitions by it.  A record that recovers
    (``fails_col``) ends with the attempt that succeeds.
    """
    n, _ = _attempts(policy, error_col, fails_col)
    x = failures.select(id_col, error_col, F.explode(F.sequence(F.lit(1), n)).alias("attempt"))
    k = F.col("attempt")
    delay = F.when(k == 1, F.lit(0)).otherwise(
        F.least(F.lit(policy.max_ms).cast("double"),
                F.lit(policy.initial_ms) * F.pow(F.lit(policy.multiplier), k - 2))).cast("bigint")
    if policy.retry_topic_suffix:
        src = F.when(k == 1, F.lit(topic)).otherwise(
            F.concat(F.lit(topic + policy.retry_topic_suffix), (k - 2).cast("string")))
    else:
        src = F.lit(topic)
    return x.select(id_col, error_col, "attempt", delay.alias("delay_ms"), src.alias("topic"))


def dead_letters(failures: DataFrame, policy: RetryPolicy, topic: str, id_col: str = "record_id",
                 error_col: str = "error_class", fails_col: str | None = None) -> DataFrame:
    """The dead-letter record of every record that fails to the end, with attempts made and total wait."""
    _, lost = _attempts(policy, error_col, fails_col)
    s = retry_schedule(failures.filter(lost) if fails_col else failures, policy, topic, id_col, error_col, fails_col)
    g = s.groupBy(id_col, error_col).agg(F.max("attempt").alias("attempts"),
                                         F.sum("delay_ms").alias("total_delay_ms"))
    return g.withColumn("dlt_topic", F.lit(topic + policy.dlt_suffix))
