"""Exact interpolated quantiles per key, without a key's values in one task or buffer.

Selection in two passes.  Equal values of a key are first counted (a partial aggregate, so a value that a
third of all rows share is one row per task).  The distinct values are cut into contiguous slices
(``slices.py``), and the slices' counts tell which slice holds the rank; only its values are then put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import ROWS_PER_SLICE, with_slices


def exact_quantile(rows: DataFrame, key: str, value: str, q: float, name: str = "quantile",
                   rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(``key``, total, ``name``): all rows of a key, and the ``q`` quantile of its values (nulls left out, NaN the
    greatest), interpolated between the two ranks around ``q * (n - 1)``.  Null where a key has no value."""
    each = rows.groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cut = with_slices(each, "_k", ["_v"], rows_per_slice=rows_per_slice)
    values = F.when(F.col("_v").isNotNull(), F.col("_n"))
    sums = cut.groupBy("_k", "_slice").agg(F.sum("_n").alias("_all"), F.coalesce(F.sum(values), F.lit(0)).alias("_n"))

    per_key = Window.partitionBy("_k")
    earlier = per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    place = (F.sum("_n").over(per_key) - 1) * F.lit(float(q))
    sums = sums.select("_k", "_slice", "_n", F.sum("_all").over(per_key).alias("total"), place.alias("_place"),
                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    totals = sums.groupBy("_k").agg(F.max("total").alias("total"))
    low, high = F.floor("_place"), F.ceil("_place")
    holds = lambda rank, start, n: (rank >= F.col(start)) & (rank < F.col(start) + F.col(n))
    wanted = sums.where(holds(low, "_start", "_n") | holds(high, "_start", "_n")).select(
        F.col("_k").alias("_wk"), F.col("_slice").alias("_ws"), "_place", F.col("_start").alias("_offset"))

    inside = Window.partitionBy("_k", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = (cut.where(F.col("_v").isNotNull())
             .join(wanted, F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("_slice") == F.col("_ws")))
             .withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))))
    at = lambda rank: F.max(F.when(holds(rank, "_start", "_n"), F.col("_v")))
    picked = found.groupBy(F.col("_k").alias("_pk"), "_place").agg(at(low).alias("_low"), at(high).alias("_high"))
    between = (F.when(low == high, F.col("_low"))
               .otherwise((high - F.col("_place")) * F.col("_low") + (F.col("_place") - low) * F.col("_high")))
    return (totals.join(picked, F.col("_k").eqNullSafe(F.col("_pk")), "left")
            .select(F.col("_k").alias(key), "total", between.alias(name)))
