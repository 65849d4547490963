"""Webhook delivery attempts: the state machine (T3), due retries (P17), the
retry batch with its endpoint (J6) and an endpoint's deliveries (J7).

T3 rules (webhook delivery service):
* 2xx -> count + 1, DELIVERED (terminal), delivery time set;
* other HTTP status -> count + 1; below 5 it also records an error
  ``HTTP <status>``, schedules a retry and adds **another** 1 (Q1: so HTTP
  failures count twice); at 5 or more -> EXHAUSTED (terminal);
* exception -> retry scheduled, count + 1, FAILED.
The retry wait is 30/60/120/300 s by the count at scheduling time.
Outcomes after a terminal state, or once 5 attempts are counted, are ignored;
FAILED with 5 is never retried by the scheduler (Q2) and reported ``stuck``.

The fold runs per delivery through :func:`ordered_fold`, so even a delivery
with a third of all outcome rows is cut over many tasks (:func:`attempt_states`).
The final state alone needs a delivery's first outcomes only (:func:`delivery_status`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered_fold import KeyFold, ordered_fold

# Fixed values of the delivery service.
MAX_ATTEMPTS = 5
BACKOFF_SECONDS = (30, 60, 120, 300)
PENDING, FAILED, DELIVERED, EXHAUSTED = "PENDING", "FAILED", "DELIVERED", "EXHAUSTED"
_INH = "__inherit__"  # placeholder for fields a transfer function takes from its entry state
_US = 1_000_000


def _absorbing(st) -> bool:
    return st[0] in (DELIVERED, EXHAUSTED) or st[1] >= MAX_ATTEMPTS


def _backoff_us(count: int) -> int:
    return BACKOFF_SECONDS[min(count, len(BACKOFF_SECONDS) - 1)] * _US


def transition(st, http, err, ts_us):
    """One outcome applied to state (status, count, http, error, next_at, delivered_at)."""
    status, count, last_http, _last_err, next_at, delivered_at = st
    if http is not None:
        c1 = count + 1
        if 200 <= http < 300:
            return (DELIVERED, c1, http, None, next_at, ts_us)
        if c1 < MAX_ATTEMPTS:
            return (FAILED, c1 + 1, http, f"HTTP {http}", ts_us + _backoff_us(c1), delivered_at)
        return (EXHAUSTED, c1, http, None, next_at, delivered_at)
    return (FAILED, count + 1, last_http, err, ts_us + _backoff_us(count), delivered_at)


_FIELDS = ("status", "attempt_count", "last_http_status", "last_error", "next_attempt_us", "delivered_us")


def run(st, seg, want_rows: bool = True):
    """Fold a slice from ``st``; returns (per-row state columns or None, ignored flags, exit state).

    Python touches rows only until the state is terminal - at most 5 counted
    outcomes - and fills the rest of the slice by array slicing.
    """
    ts = np.asarray(seg["ts"]).astype("datetime64[us]").astype(np.int64)
    h = np.asarray(seg["http_status"], dtype=float)
    e = seg["error"]
    n = len(ts)
    cols = [np.empty(n, dtype=object) for _ in _FIELDS] if want_rows else None
    ignored = np.zeros(n, dtype=bool)
    i = 0
    while i < n and not _absorbing(st):
        http = None if np.isnan(h[i]) else int(h[i])
        err = e[i] if isinstance(e[i], str) else None
        st = transition(st, http, err, int(ts[i]))
        if want_rows:
            for c, v in zip(cols, st):
                c[i] = v
        i += 1
    if i < n:
        ignored[i:] = True
        if want_rows:
            for c, v in zip(cols, st):
                c[i:] = v
    return cols, ignored, st


# Entry phases that are not terminal: PENDING with 0, FAILED with 1..4.
_PHASES = [(PENDING, 0)] + [(FAILED, c) for c in range(1, MAX_ATTEMPTS)]


class DeliveryFold(KeyFold):
    result_ddl = ("status string, attempt_count int, last_http_status int, last_error string, "
                  "next_attempt_us bigint, delivered_us bigint, ignored boolean")
    input_cols = ("http_status", "error", "ts")

    def init(self, key):
        return (PENDING, 0, None, None, None, None)

    def step(self, key, seg, state):
        cols, ignored, st = run(state, seg)
        out = dict(zip(_FIELDS, cols))
        out["ignored"] = ignored
        return out, st

    def step_many(self, keys, segs, arrs, entries):
        """All deliveries of a batch at once: one numpy step per outcome
        position; a delivery stops at its terminal state, which every one
        reaches within 5 counted outcomes."""
        starts = np.array([a for a, _ in segs], dtype=np.int64)
        lens = np.array([b - a for a, b in segs], dtype=np.int64)
        n = int(lens.sum())
        ts = np.asarray(arrs["ts"]).astype("datetime64[us]").astype(np.int64)
        h = np.asarray(arrs["http_status"], dtype=float)
        e = arrs["error"]
        st = np.array([x[0] for x in entries], dtype=object)
        cnt = np.array([x[1] for x in entries], dtype=np.int64)
        http = np.array([x[2] for x in entries], dtype=object)
        err = np.array([x[3] for x in entries], dtype=object)
        nxt = np.array([x[4] for x in entries], dtype=object)
        dlv = np.array([x[5] for x in entries], dtype=object)
        out = {f: np.empty(n, dtype=object) for f in _FIELDS}
        done = np.zeros(len(segs), dtype=np.int64)           # outcomes consumed per delivery
        backoff = np.array(BACKOFF_SECONDS, dtype=np.int64) * _US
        j = 0
        while True:
            live = np.flatnonzero((lens > j) & ~np.isin(st, (DELIVERED, EXHAUSTED)) & (cnt < MAX_ATTEMPTS))
            if len(live) == 0:
                break
            rows = starts[live] + j
            hv, tv = h[rows], ts[rows]
            exc = np.isnan(hv)
            ok = ~exc & (hv >= 200) & (hv < 300)
            bad = ~exc & ~ok
            c0 = cnt[live]
            c1 = c0 + 1
            retry = bad & (c1 < MAX_ATTEMPTS)
            # exceptions: retry time from the count before, +1
            i = live[exc]
            nxt[i] = tv[exc] + backoff[np.minimum(c0[exc], len(BACKOFF_SECONDS) - 1)]
            cnt[i] = c0[exc] + 1
            err[i] = [x if isinstance(x, str) else None for x in np.asarray(e, dtype=object)[rows[exc]]]
            st[i] = FAILED
            # 2xx
            i = live[ok]
            st[i], cnt[i], err[i], dlv[i] = DELIVERED, c1[ok], None, tv[ok]
            http[i] = hv[ok].astype(np.int64)
            # other HTTP: below 5 -> error recorded and counted again; else exhausted
            i = live[retry]
            st[i], cnt[i] = FAILED, c1[retry] + 1
            http[i] = hv[retry].astype(np.int64)
            err[i] = ["HTTP " + str(int(x)) for x in hv[retry]]
            nxt[i] = tv[retry] + backoff[np.minimum(c1[retry], len(BACKOFF_SECONDS) - 1)]
            ex = bad & ~retry
            i = live[ex]
            st[i], cnt[i], err[i] = EXHAUSTED, c1[ex], None
            http[i] = hv[ex].astype(np.int64)
            for f, arr in zip(_FIELDS, (st, cnt, http, err, nxt, dlv)):
                out[f][rows] = arr[live]
            done[live] += 1
            j += 1
        # outcomes after the terminal state keep it and are flagged ignored
        seg_of = np.repeat(np.arange(len(segs)), lens)
        pos = np.arange(n) - np.repeat(starts, lens)
        ignored = pos >= done[seg_of]
        if ignored.any():
            for f, arr in zip(_FIELDS, (st, cnt, http, err, nxt, dlv)):
                out[f][ignored] = arr[seg_of[ignored]]
        for f in ("attempt_count", "last_http_status", "next_attempt_us", "delivered_us"):
            out[f] = np.array([None if v is None else int(v) for v in out[f]], dtype=object)
        out["ignored"] = ignored
        exits = [(st[k], int(cnt[k]), None if http[k] is None else int(http[k]), err[k],
                  None if nxt[k] is None else int(nxt[k]), None if dlv[k] is None else int(dlv[k]))
                 for k in range(len(segs))]
        return out, exits

    def tf_identity(self):
        return {p: (p[0], p[1], _INH, _INH, _INH, _INH) for p in _PHASES}

    def tf_step(self, tf, seg):
        return {p: run(st, seg, want_rows=False)[2] for p, st in tf.items()}

    def tf_apply(self, tf, state):
        if _absorbing(state) or (state[0], state[1]) not in tf:
            return state
        ex = tf[(state[0], state[1])]
        return tuple(state[i] if ex[i] == _INH else ex[i] for i in range(6))

    def tf_compose(self, first, second):
        # placeholders in `first` stay placeholders: they still mean "the entry's value"
        return {p: self.tf_apply(second, ex) for p, ex in first.items()}


def attempt_states(attempts: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The delivery state after every attempt outcome (ignored ones flagged)."""
    f = ordered_fold(attempts, "delivery_id", ["ts", "attempt_id"], DeliveryFold(), num_partitions)
    return (f.withColumn("next_attempt_at", F.timestamp_micros("next_attempt_us"))
             .withColumn("delivered_at", F.timestamp_micros("delivered_us"))
             .drop("next_attempt_us", "delivered_us"))


def _next_state(st: Column, x: Column) -> Column:
    """One outcome applied to a delivery's state, both as structs."""
    failed, http = x["http_status"].isNull(), x["http_status"]
    delivered = ~failed & (http >= 200) & (http < 300)
    counted = st["attempt_count"] + 1
    again = failed | (~delivered & (counted < MAX_ATTEMPTS))   # a retry is scheduled, by the count at that time
    at_count = F.when(failed, st["attempt_count"]).otherwise(counted)
    waits = F.array(*[F.lit(w) for w in BACKOFF_SECONDS])
    wait = F.element_at(waits, F.least(at_count, F.lit(len(BACKOFF_SECONDS) - 1)) + 1)
    error = F.when(failed, x["error"]).when(again, F.concat(F.lit("HTTP "), http.cast("string")))
    return F.struct(
        F.when(delivered, DELIVERED).when(again, FAILED).otherwise(EXHAUSTED).alias("status"),
        (at_count + F.when(again, 1).otherwise(0)).cast("int").alias("attempt_count"),
        F.coalesce(http, st["last_http_status"]).cast("int").alias("last_http_status"), error.alias("last_error"),
        F.when(again, x["ts"] + F.make_dt_interval(secs=wait)).otherwise(st["next_attempt_at"]).alias("next_attempt_at"),
        F.when(delivered, x["ts"]).otherwise(st["delivered_at"]).alias("delivered_at"),
        (st["outcomes_used"] + 1).alias("outcomes_used"))


def delivery_status(attempts: DataFrame) -> DataFrame:
    """The state of every delivery after all its outcomes.

    Each counted outcome adds one attempt or more and nothing counts from ``MAX_ATTEMPTS`` on, so the first
    outcomes by (ts, attempt_id) decide.  They are taken by rank, which is cut in the task before the only
    shuffle of outcome rows, and folded as a short array in the JVM.  All outcomes are counted by a
    partial aggregate, a row for each delivery and task.  Equals the last state of ``attempt_states``.
    """
    first = Window.partitionBy("delivery_id").orderBy("ts", "attempt_id")
    few = (attempts.select("delivery_id", "attempt_id", F.col("ts").cast("timestamp").alias("ts"), F.col("http_status").cast("int").alias("http_status"), "error")
           .withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= MAX_ATTEMPTS))
    runs = few.groupBy("delivery_id").agg(F.array_sort(F.collect_list(F.struct("_k", "ts", "http_status", "error"))).alias("_run"))
    seen = attempts.groupBy(F.col("delivery_id").alias("_seen_id")).agg(F.count(F.lit(1)).alias("outcomes_seen"))
    null = F.lit(None)
    start = F.struct(F.lit(PENDING).alias("status"), F.lit(0).alias("attempt_count"), null.cast("int").alias("last_http_status"),
                     null.cast("string").alias("last_error"), null.cast("timestamp").alias("next_attempt_at"),
                     null.cast("timestamp").alias("delivered_at"), F.lit(0).cast("long").alias("outcomes_used"))

    def fold(st: Column, x: Column) -> Column:
        over = st["status"].isin(DELIVERED, EXHAUSTED) | (st["attempt_count"] >= MAX_ATTEMPTS)
        return F.when(over, st).otherwise(_next_state(st, x))

    s = runs.join(seen, F.col("delivery_id").eqNullSafe(F.col("_seen_id"))) \
            .select("delivery_id", F.aggregate("_run", start, fold).alias("s"), "outcomes_seen")
    return s.select("delivery_id", "s.*", "outcomes_seen",
                    ((F.col("s.status") == FAILED) & (F.col("s.attempt_count") >= MAX_ATTEMPTS)).alias("stuck"))


def due_retries(deliveries: DataFrame, now, page: int = 50) -> DataFrame:
    """FAILED, next attempt unset or due, fewer than 5 attempts; one page.

    The reference gives no order; ours is (next_attempt_at, delivery_id), which
    Spark runs as a top-k (TakeOrderedAndProject), not a full sort.
    """
    due = deliveries.filter((F.col("status") == FAILED)
                            & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
                            & (F.col("attempt_count") < MAX_ATTEMPTS))
    return due.orderBy(F.col("next_attempt_at").asc_nulls_first(), "delivery_id").limit(page)


def retry_batch(due: DataFrame, deliveries_meta: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Due deliveries with their endpoint; a missing endpoint skips the row.

    The endpoint's status is not checked again (as in the reference).
    """
    d = due.join(deliveries_meta, "delivery_id", "inner")
    e = endpoints.select(F.col("id").alias("endpoint_id"), "url", "secret",
                         F.col("status").alias("endpoint_status"))
    return d.join(e, "endpoint_id", "inner")


def endpoint_deliveries(deliveries: DataFrame, endpoints: DataFrame, endpoint_id: str,
                        tenant_id: str) -> DataFrame:
    """An endpoint's deliveries, only when the endpoint belongs to the tenant."""
    own = endpoints.filter((F.col("id") == endpoint_id) & (F.col("tenant_id") == tenant_id)) \
                   .select(F.col("id").alias("endpoint_id"))
    return deliveries.join(own, "endpoint_id", "left_semi")
