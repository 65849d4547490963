"""Streaming forms of the rate limit (T2) and the delivery state machine
with keyed state in the state store.

Each processor gathers a key's rows of the micro-batch, sorts them in arrival
order and continues the fold from the stored state with the same functions
the batch jobs use, so stream = batch when inputs arrive in time order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

from ..functions.plans import rate_limit
from ..operators import delivery as dl
from ..operators.ratelimit import WINDOW_MS, window_scan

_RATE_STATE = T.StructType([T.StructField("window_start", T.LongType()),
                            T.StructField("request_count", T.LongType())])
_DELIVERY_STATE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("attempt_count", T.IntegerType()),
    T.StructField("last_http_status", T.IntegerType()), T.StructField("last_error", T.StringType()),
    T.StructField("next_attempt_us", T.LongType()), T.StructField("delivered_us", T.LongType())])


class RateLimitProcessor(StatefulProcessor):
    """T2 per tenant: state = (window start, count)."""

    def __init__(self, width: int = WINDOW_MS):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", _RATE_STATE)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["req_ms", "ts", "request_id"], kind="stable").reset_index(drop=True)
        w, c = (self.state.get() if self.state.exists() else (None, 0))
        ws, cnt, w, c = window_scan(pdf["req_ms"].to_numpy(dtype=np.int64), w, int(c), self.width)
        self.state.update((int(w), int(c)))
        pdf["window_start"] = ws
        pdf["request_count"] = cnt
        yield pdf

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, width: int = WINDOW_MS) -> DataFrame:
    """T2 on a stream of requests; unlimited plans and rows without tenant pass uncounted."""
    ship_package(requests.sparkSession)
    lim = rate_limit(F.col("plan"))
    if "path" in requests.columns:   # health probes are not limited
        lim = F.when(~F.coalesce(F.col("path").startswith("/actuator"), F.lit(False)), lim)
    r = requests.withColumn("rate_limit", lim)
    counted = r.filter(F.col("tenant_id").isNotNull() & F.col("rate_limit").isNotNull())
    out = T.StructType(list(counted.schema.fields) + [T.StructField("window_start", T.LongType()),
                                                      T.StructField("request_count", T.LongType())])
    free = r.filter(F.col("tenant_id").isNull() | F.col("rate_limit").isNull())
    f = counted.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=RateLimitProcessor(width), outputStructType=out, outputMode="Append",
        timeMode="None")
    allowed = F.col("request_count") <= F.col("rate_limit")
    limited = f.select("*", allowed.alias("allowed"),
                       F.when(allowed, F.greatest(F.lit(0).cast("bigint"), F.col("rate_limit") - F.col("request_count")))
                       .alias("remaining"))
    none = F.lit(None).cast("bigint")
    return limited.unionByName(free.select("*", none.alias("window_start"), none.alias("request_count"),
                                           F.lit(True).alias("allowed"), none.alias("remaining")))


class DeliveryProcessor(StatefulProcessor):
    """T3 per delivery: state = the delivery row's six fields."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("delivery", _DELIVERY_STATE)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["ts", "attempt_id"], kind="stable").reset_index(drop=True)
        st = tuple(self.state.get()) if self.state.exists() else (dl.PENDING, 0, None, None, None, None)
        cols, ignored, st = dl.run(st, {c: pdf[c].to_numpy() for c in ("ts", "http_status", "error")})
        self.state.update(tuple(None if v is None else v for v in st))
        for name, col in zip(dl._FIELDS, cols):
            pdf[name] = col
        pdf["ignored"] = ignored
        yield pdf

    def close(self) -> None:
        pass


def delivery_stream(attempts: DataFrame) -> DataFrame:
    """T3 on a stream of attempt outcomes: the delivery state after each outcome."""
    ship_package(attempts.sparkSession)
    out = T.StructType(list(attempts.schema.fields) + list(_DELIVERY_STATE.fields)
                       + [T.StructField("ignored", T.BooleanType())])
    return attempts.groupBy("delivery_id").transformWithStateInPandas(
        statefulProcessor=DeliveryProcessor(), outputStructType=out, outputMode="Append", timeMode="None")
