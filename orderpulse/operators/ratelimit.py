"""The gateway's per-tenant request limit.

Rule: a tenant's window opens at its first request; a request more than
``window_ms`` after the window start opens a new window and resets the count.
Every request is counted, refused ones too, and a request is refused when the
count exceeds the plan's limit.  Requests without a tenant, unlimited plans
(ENTERPRISE) and ``/actuator`` paths pass without touching the counters.

The windows are not aligned to the clock (not ``window()``) and have no gap
rule (not ``session_window``): each start depends on the previous start.
:func:`rate_limit_decisions` chains the windows of the distinct times
(``chained_windows``); :class:`RateFold` is the same rule as an ordered fold
for micro-batches, where a tenant's open window goes on from a stored state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plans import rate_limit
from .chained_windows import chained_windows
from .ordered_fold import KeyFold

# Fixed value: window length in milliseconds.
WINDOW_MS = 60_000


def window_scan(t: np.ndarray, w, c: int, width: int):
    """Window start and in-window count for sorted times ``t`` from state (w, c)."""
    n = len(t)
    ws = np.empty(n, dtype=np.int64)
    cnt = np.empty(n, dtype=np.int64)
    i = 0
    if w is not None and n:
        k = int(np.searchsorted(t, w + width, side="right"))
        ws[:k] = w
        cnt[:k] = c + np.arange(1, k + 1)
        c += k
        i = k
    while i < n:
        w = int(t[i])
        k = int(np.searchsorted(t, w + width, side="right"))
        ws[i:k] = w
        cnt[i:k] = np.arange(1, k - i + 1)
        c = k - i
        i = k
    return ws, cnt, w, c


def _advance(cw: np.ndarray, cc: np.ndarray, t: np.ndarray, width: int):
    """Advance many chains (window start, count) through sorted times ``t``."""
    n = len(t)
    if n == 0 or len(cw) == 0:
        return cw, cc
    cw, cc = cw.copy(), cc.copy()
    k = np.searchsorted(t, cw + width, side="right")
    cc = cc + k
    act = np.flatnonzero(k < n)
    while len(act):
        w_new = t[k[act]]
        k2 = np.searchsorted(t, w_new + width, side="right")
        cw[act] = w_new
        cc[act] = k2 - k[act]
        k[act] = k2
        act = act[k2 < n]
    return cw, cc


class _RateTF:
    """Transfer function of a tenant slice: entry window -> exit window.

    With entry window start ``s`` the first new window opens at the first
    request later than ``s + width``; since ``s`` is at most the slice's first
    time, that request lies in the slice's first ``width`` ms (or is the next
    one).  One chain per such candidate start is carried, merged when chains
    meet.
    """

    def __init__(self):
        self.n = 0
        self.t_first = None
        self.buf: list[np.ndarray] = []
        self.closed = False
        self.cand_t = np.empty(0, dtype=np.int64)
        self.chain_of = np.empty(0, dtype=np.int64)
        self.cw = np.empty(0, dtype=np.int64)
        self.cc = np.empty(0, dtype=np.int64)

    def _close(self, width: int):
        T = np.concatenate(self.buf) if self.buf else np.empty(0, dtype=np.int64)
        self.buf = []
        self.closed = True
        if len(T) == 0:
            return
        first_of_group = np.concatenate(([True], T[1:] != T[:-1]))
        inwin = T <= self.t_first + width
        idx = np.flatnonzero(first_of_group & inwin)
        beyond = np.flatnonzero(~inwin)
        if len(beyond):
            idx = np.concatenate((idx, beyond[:1]))
        cw = T[idx].astype(np.int64)
        cc = -idx.astype(np.int64)
        cw, cc = _advance(cw, cc, T, width)
        self.cand_t = T[idx].astype(np.int64)
        self._set_chains(np.arange(len(idx)), cw, cc)

    def _set_chains(self, chain_of, cw, cc):
        uniq, first, inv = np.unique(cw, return_index=True, return_inverse=True)
        self.cw, self.cc = uniq, cc[first]
        self.chain_of = inv[chain_of]

    def step(self, t: np.ndarray, width: int):
        if len(t) == 0:
            return
        if self.t_first is None:
            self.t_first = int(t[0])
        self.n += len(t)
        if not self.closed:
            self.buf.append(t)
            if t[-1] > self.t_first + width:
                self._close(width)
            return
        cw, cc = _advance(self.cw, self.cc, t, width)
        self._set_chains(self.chain_of, cw, cc)

    @staticmethod
    def compose(f: "_RateTF", g: "_RateTF", width: int) -> "_RateTF":
        """``f``'s slice then ``g``'s.  The candidates of ``f`` keep their
        chains (mapped through ``g``); ``g``'s candidates are kept only where an
        entry can pass through ``f`` inside one window - never more than the
        distinct times of one window, so the size stays bounded."""
        if f.n == 0:
            return g
        if g.n == 0:
            return f
        h = _RateTF()
        h.n, h.t_first, h.closed = f.n + g.n, f.t_first, True
        f_exit = [g.apply((int(f.cw[c]), int(f.cc[c])), width) for c in range(len(f.cw))]
        fw = np.array([e[0] for e in f_exit], dtype=np.int64)
        fc = np.array([e[1] for e in f_exit], dtype=np.int64)
        hi = f.t_first + width
        if len(f.cand_t) and f.cand_t[-1] > hi:
            need = np.empty(0, dtype=np.int64)
        else:
            lo = f.cand_t[-1] if len(f.cand_t) else f.t_first
            need = np.flatnonzero((g.cand_t > lo) & (g.cand_t <= hi))
            beyond = np.flatnonzero(g.cand_t > hi)
            if len(beyond):
                need = np.concatenate((need, beyond[:1]))
        h.cand_t = np.concatenate((f.cand_t, g.cand_t[need])).astype(np.int64)
        gw, gc = g.cw[g.chain_of[need]], g.cc[g.chain_of[need]]
        cw = np.concatenate((fw[f.chain_of], gw)).astype(np.int64)
        cc = np.concatenate((fc[f.chain_of], gc)).astype(np.int64)
        h._set_chains(np.arange(len(h.cand_t)), cw, cc)
        return h

    def apply(self, state, width: int):
        w0, c0 = state
        if self.n == 0:
            return state
        if w0 is None or self.t_first > w0 + width:
            j = 0
        else:
            j = int(np.searchsorted(self.cand_t, w0 + width, side="right"))
            if j >= len(self.cand_t):
                return (w0, c0 + self.n)
        ch = self.chain_of[j]
        return (int(self.cw[ch]), int(self.cc[ch]))


class RateFold(KeyFold):
    result_ddl = "window_start bigint, request_count bigint"

    def __init__(self, time_col: str = "req_ms", width: int = WINDOW_MS):
        self.time_col = time_col
        self.width = int(width)
        self.input_cols = (time_col,)

    def init(self, key):
        return (None, 0)

    def step(self, key, seg, state):
        t = np.asarray(seg[self.time_col], dtype=np.int64)
        ws, cnt, w, c = window_scan(t, state[0], int(state[1]), self.width)
        return {"window_start": ws, "request_count": cnt}, (w, c)

    def tf_identity(self):
        return _RateTF()

    def tf_step(self, tf, seg):
        tf.step(np.asarray(seg[self.time_col], dtype=np.int64), self.width)
        return tf

    def tf_finish(self, tf):
        if not tf.closed:
            tf._close(self.width)
        return tf

    def tf_apply(self, tf, state):
        return tf.apply(state, self.width)

    def tf_compose(self, first, second):
        return _RateTF.compose(first, second, self.width)


def rate_limit_decisions(requests: DataFrame, limit: Column | None = None,
                         key: str = "tenant_id", time_col: str = "req_ms",
                         order: tuple[str, ...] = ("req_ms", "ts", "request_id"),
                         width: int = WINDOW_MS) -> DataFrame:
    """Allowed / refused per request with window start, count and remaining.

    ``limit`` is a column giving each request's limit (null = not limited);
    by default the plan table of the gateway (unknown plan -> 100).  A request
    without a time passes uncounted, as one without a tenant does.

    Only a count per tenant and distinct time goes through the chain of windows; whole
    rows are shuffled once by (tenant, time), to rank requests of one millisecond.
    """
    lim = limit if limit is not None else rate_limit(F.col("plan"))
    if "path" in requests.columns:   # health probes are not limited
        lim = F.when(~F.coalesce(F.col("path").startswith("/actuator"), F.lit(False)), lim)
    r = requests.withColumn("rate_limit", lim)
    has_window = F.col(key).isNotNull() & F.col(time_col).isNotNull() & F.col("rate_limit").isNotNull()
    counted, passed = r.filter(has_window), r.filter(~has_window)
    times = counted.groupBy(key, F.col(time_col).cast("bigint").alias("_time")).agg(F.count("*").alias("_n"))
    starts = chained_windows(times, key, "_time", "_n", width)
    earlier = Window.partitionBy(key, "window_start").orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    opened = starts.select(key, "_time", "window_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    ranked = (counted.withColumn("_time", F.col(time_col).cast("bigint"))
              .withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_time").orderBy(*order))))
    count = F.col("_earlier") + F.col("_rank")
    folded = ranked.join(opened, [key, "_time"]).select(*(F.col(c) for c in r.columns), "window_start", count.alias("request_count"))
    allowed = F.col("request_count") <= F.col("rate_limit")
    a = folded.select("*", allowed.alias("allowed"),
                      F.when(allowed, F.greatest(F.lit(0).cast("bigint"),
                                                 F.col("rate_limit") - F.col("request_count")))
                      .alias("remaining"))
    b = passed.select("*", F.lit(None).cast("bigint").alias("window_start"),
                      F.lit(None).cast("bigint").alias("request_count"),
                      F.lit(True).alias("allowed"), F.lit(None).cast("bigint").alias("remaining"))
    return a.unionByName(b)
