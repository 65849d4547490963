"""Keyed folds over streams in which no key is tied to one worker.

Each micro-batch is folded by the batch operator, which cuts a hot key into slices over many tasks.  The state of the keys
that a batch touched is a table of its own, committed together with the batch's rows (``committed``), so after a
failure both are there or neither, and a replayed batch starts from the same states.  The state is read per key
and travels with the key's rows; the fold takes it where the key's first slice begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import rate_limit
from ..operators import delivery, ratelimit, reserve
from ..operators.hot_join import attach
from ..operators.ordered_fold import KeyFold, ordered_fold
from .committed import BATCH, CommittedTables, latest
from .jobs import INTERVAL, triggered

ENTRY = "_entry_state"
_UNREAD = "unread"


class Resumed(KeyFold):
    """``inner``, starting from the state that the key's rows carry in ``ENTRY`` (JSON; null: the initial state).

    A state of None stands for "at the key's start".  A transfer function is the pair of the stored state,
    once a row has shown it, and the inner function."""

    def __init__(self, inner: KeyFold, load: Callable[[dict], Any]):
        self.inner, self.load = inner, load
        self.result_ddl = inner.result_ddl
        self.input_cols = (*inner.input_cols, ENTRY)

    def init(self, key):
        return None

    def _start(self, seg: dict, key: Any) -> Any:
        text = seg[ENTRY][0]
        return self.load(json.loads(text)) if isinstance(text, str) else self.inner.init(key)

    def step(self, key, seg, state):
        return self.inner.step(key, seg, self._start(seg, key) if state is None else state)

    def tf_identity(self):
        return (_UNREAD, self.inner.tf_identity())

    def tf_step(self, tf, seg):
        return (self._start(seg, None) if tf[0] is _UNREAD or tf[0] == _UNREAD else tf[0], self.inner.tf_step(tf[1], seg))

    def tf_finish(self, tf):
        return (tf[0], self.inner.tf_finish(tf[1]))

    def tf_apply(self, tf, state):
        start = tf[0] if state is None else state
        return self.inner.tf_apply(tf[1], start)

    def tf_compose(self, first, second):
        return (first[0], self.inner.tf_compose(first[1], second[1]))


class ResumedMany(Resumed):
    """``Resumed`` for folds that take all keys of a batch at once."""

    def step_many(self, keys, segs, arrs, entries):
        starts = [self._start({ENTRY: arrs[ENTRY][a:b]}, keys[a]) if e is None else e for (a, b), e in zip(segs, entries)]
        return self.inner.step_many(keys, segs, arrs, starts)


@dataclass(frozen=True)
class KeyedJob:
    """A fold with the result columns that make its state, and how they are read back."""

    key: str
    order: tuple[str, ...]
    fold: KeyFold
    state: tuple[str, ...]
    load: Callable[[dict], Any]

    def resumed(self) -> KeyFold:
        return (ResumedMany if hasattr(self.fold, "step_many") else Resumed)(self.fold, self.load)


def _stock(s: dict) -> int:
    return int(s["remaining"])


def _window(s: dict) -> tuple:
    return (s["window_start"], s["request_count"])


_DELIVERY = ("status", "attempt_count", "last_http_status", "last_error", "next_attempt_us", "delivered_us")


def _delivery(s: dict) -> tuple:
    return tuple(s.get(c) for c in _DELIVERY)   # null fields are not written


def stock_job(initial_stock: int = reserve.DEFAULT_STOCK) -> KeyedJob:
    """Units left of each product."""
    return KeyedJob("product_id", ("placed_at", "order_id"), reserve.StockFold(initial_stock), ("remaining",), _stock)


def rate_job(width: int = ratelimit.WINDOW_MS) -> KeyedJob:
    """The open window of each tenant; rows are those that count against a limit."""
    return KeyedJob("tenant_id", ("req_ms", "ts", "request_id"), ratelimit.RateFold("req_ms", width), ("window_start", "request_count"), _window)


def delivery_job() -> KeyedJob:
    """The row of each delivery."""
    return KeyedJob("delivery_id", ("ts", "attempt_id"), delivery.DeliveryFold(), _DELIVERY, _delivery)


def limited_requests(requests: DataFrame) -> DataFrame:
    """The requests that T2 counts, with their limit."""
    r = requests.withColumn("rate_limit", rate_limit(F.col("plan")))
    if "path" in requests.columns:   # health probes are not limited
        r = r.filter(~F.coalesce(F.col("path").startswith("/actuator"), F.lit(False)))
    return r.filter(F.col("tenant_id").isNotNull() & F.col("rate_limit").isNotNull())


def fold_batch(batch: DataFrame, states: DataFrame | None, job: KeyedJob, num_partitions: int | None = None) -> DataFrame:
    """The rows of a batch folded from ``states`` (key and state columns), with the fold's columns."""
    if states is None:
        rows = batch.withColumn(ENTRY, F.lit(None).cast("string"))
    else:
        table = states.select(job.key, F.to_json(F.struct(*job.state)).alias(ENTRY))
        rows = attach(batch, table, job.key)
    return ordered_fold(rows, job.key, list(job.order), job.resumed(), num_partitions).drop(ENTRY)


def exit_states(folded: DataFrame, job: KeyedJob) -> DataFrame:
    """The state of each key after its last row."""
    last = F.max_by(F.struct(*job.state), F.struct(*job.order)).alias("s")
    return folded.groupBy(job.key).agg(last).select(job.key, "s.*")


def states_before(tables: CommittedTables, job: KeyedJob, batch_id: int | None = None) -> DataFrame | None:
    """The state of every key before a batch (None: now)."""
    rows = tables.read("state", batch_id)
    return None if rows is None else latest(job.key)(rows).drop(BATCH)


def keyed_stream(rows: DataFrame, job: KeyedJob, root: str, checkpoint: str, num_partitions: int | None = None,
                 compact_every: int = 50, available_now: bool = True, interval: str = INTERVAL):
    """Fold a stream into the committed tables ``rows`` and ``state`` under ``root``.  States are merged to one
    row for each key every ``compact_every`` batches."""
    spark: SparkSession = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = CommittedTables(spark, root)
        if batch_id in tables.batches() or batch.isEmpty():
            return
        folded = fold_batch(batch, states_before(tables, job, batch_id), job, num_partitions)
        tables.commit(batch_id, {"rows": folded, "state": exit_states(folded, job)})
        if (batch_id + 1) % compact_every == 0:
            tables.compact("state", latest(job.key))

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(w, available_now, interval).start()
