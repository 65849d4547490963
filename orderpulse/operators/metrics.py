"""Operational measures: orders per minute (A9), p99 latency from histogram
buckets and exactly (A10), the rolling failure rate (A11) and trace ids out of
log lines (F11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trace_id
from .quantiles import exact_quantile
from .slices import ROWS_PER_SLICE, with_slices


def orders_per_minute(orders: DataFrame, ts_col: str = "placed_at") -> DataFrame:
    """Order counts over a 1-minute window sliding every 30 seconds.

    A partial aggregate per window: each row lands in two windows, combined
    map-side before the shuffle.  On a stream the same expression runs with a
    watermark (see ``orderpulse.streaming``).
    """
    w = F.window(ts_col, "1 minute", "30 seconds")
    g = orders.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("orders"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "orders")


def latency_p99_hist(latency: DataFrame, buckets: tuple[float, ...], q: float = 0.99,
                     ts_col: str = "ts", value_col: str = "seconds",
                     window: str = "5 minutes") -> DataFrame:
    """A10: the quantile from cumulative ``le`` bucket counts, interpolated
    linearly inside the bucket holding the rank (upper bound of the last finite
    bucket when the rank falls into +Inf).  One pass, 12 partial counters per
    window."""
    v = F.col(value_col)
    aggs = [F.count(F.when(v <= F.lit(le), 1)).alias(f"c{i}") for i, le in enumerate(buckets)]
    g = latency.groupBy(F.window(ts_col, window).alias("w")).agg(F.count(F.lit(1)).alias("total"), *aggs)
    rank = F.lit(q) * F.col("total")
    res = F.lit(buckets[-1])
    for i in reversed(range(len(buckets))):
        lo = F.lit(0.0) if i == 0 else F.lit(buckets[i - 1])
        c_lo = F.lit(0) if i == 0 else F.col(f"c{i - 1}")
        c_hi = F.col(f"c{i}")
        val = lo + (F.lit(buckets[i]) - lo) * (rank - c_lo) / (c_hi - c_lo)
        res = F.when(c_hi >= rank, val).otherwise(res)
    # seconds at nanosecond precision: engines differ in the last bits of the interpolation
    return g.select(F.col("w.start").alias("window_start"), "total", F.round(res, 9).alias("p99_seconds"))


def latency_p99(latency: DataFrame, q: float = 0.99, ts_col: str = "ts", value_col: str = "seconds",
                window: str = "5 minutes", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A10 exact form: the interpolated percentile of the raw values per window.

    Two-pass selection (``quantiles.py``): a window's distinct values are cut
    into slices and only the slices that hold the rank are put in order, so no
    task holds a whole window; :func:`latency_p99_hist` - the dashboard's own
    method - has 12 counters per window whatever the data.
    """
    rows = latency.select(F.window(ts_col, window).alias("w"), F.col(value_col).alias("value")).select(F.col("w.start").alias("window_start"), "value")
    g = exact_quantile(rows, "window_start", "value", q, "p99_seconds", rows_per_slice)
    return g.select("window_start", "total", F.round("p99_seconds", 9).alias("p99_seconds"))


# Fixed values of the circuit-breaker setting: 20 calls, 50 % failures.
WINDOW_CALLS = 20
FAILURE_THRESHOLD = 0.5


def failure_rate(calls: DataFrame, key: str, order: list[str], failed_col: str = "failed",
                 size: int = WINDOW_CALLS, threshold: float = FAILURE_THRESHOLD,
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Failure rate over the last ``size`` calls per key, flagged once the
    window is full and the rate reaches ``threshold``.

    Same result as ``avg(failed) over (partition by key order by ...
    rows between size-1 preceding and current row)``, without a key's rows in
    one task: the window runs in contiguous slices of a key, and the first
    rows of a slice add the last flags before it.  Whole rows are shuffled
    once; the flags before a slice are ``size - 1`` numbers for each
    ``rows_per_slice`` rows and broadcast.  A null flag is a call that did not
    fail, a null key is a key.
    """
    flagged = calls.withColumn("_flag", F.coalesce(F.col(failed_col).cast("int"), F.lit(0)))
    sliced = with_slices(flagged, key, order, rows_per_slice=rows_per_slice)
    own = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(-(size - 1), 0)
    rows = sliced.select("*", F.count(F.lit(1)).over(own).cast("int").alias("_own_calls"),
                         F.sum("_flag").over(own).cast("int").alias("_own_failures"))
    carry = _flags_before(sliced.select(key, *order, "_flag", "_slice"), key, order, size - 1)
    x = rows.join(F.broadcast(carry), rows[key].eqNullSafe(F.col("_carry_key")) & (F.col("_slice") == F.col("_carry_slice")), "left")
    before = F.coalesce("_before", F.array().cast("array<int>"))
    taken = F.least(F.size(before), F.lit(size) - F.col("_own_calls"))
    carried = F.aggregate(F.slice(before, F.size(before) - taken + 1, taken), F.lit(0), lambda a, b: a + b)
    calls_n, failures = F.col("_own_calls") + taken, F.col("_own_failures") + F.when(taken > 0, carried).otherwise(0)
    rate = F.col("failures") / F.col("calls")
    names = [F.col(f"`{c}`") for c in calls.columns]
    return x.select(*names, calls_n.alias("calls"), failures.alias("failures")).select(
        "*", rate.alias("failure_rate"), ((F.col("calls") == size) & (rate >= threshold)).alias("flagged"))


def _flags_before(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """(key, slice, the last ``n`` flags of the key before the slice) where there are any."""
    later = F.lead(F.lit(1), n).over(Window.partitionBy(key, "_slice").orderBy(*order))
    tails = (rows.withColumn("_later", later).where(F.col("_later").isNull())   # a slice's last n rows
             .groupBy(key, "_slice").agg(F.sort_array(F.collect_list(F.struct(*order, "_flag"))).alias("_tail")))
    # a slice has a row at least, so the n slices before hold the n flags
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(-n, -1)
    flags = F.flatten(F.collect_list(F.col("_tail._flag")).over(earlier))
    last = F.slice("_flags", F.greatest(F.size("_flags") - n + 1, F.lit(1)), F.lit(n))
    return (tails.withColumn("_flags", flags).where(F.size("_flags") > 0)
            .select(F.col(key).alias("_carry_key"), F.col("_slice").alias("_carry_slice"), last.alias("_before")))


def log_trace_ids(logs: DataFrame, line_col: str = "line") -> DataFrame:
    """the trace id of each log line (null when the line has none)."""
    return logs.withColumn("trace_id", trace_id(F.col(line_col)))
