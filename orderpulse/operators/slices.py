"""Contiguous slices of a key's rows, for windows over keys that are too long for one task.

A slice number depends on the row's own values alone: one row of every so many, picked by hash, is a
sample; every few sampled rows of a key, one gives a bound; and a row's slice is the number of its
key's bounds at or below its leading order value.  Recomputed or reused, any part of a plan gives a
row the same slice.  A key with fewer than about ``rows_per_slice`` rows has no bound and one slice.

The bounds are broadcast: one value for each ``rows_per_slice`` rows, 8 bytes for 4 million rows.
Rows that share a key and a leading order value stay in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 4_000_000
_SAMPLED_PER_SLICE = 32


def with_slices(df: DataFrame, key: str, order: list[str], name: str = "_slice",
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``df`` with ``name``, ascending with ``order`` (ascending, nulls first) within a key (null is a key)."""
    bounds = _bounds(df, key, order, rows_per_slice)
    out = df.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("_bound_key")), "left")
    return out.withColumn(name, _slice_of(F.col(order[0]))).drop("_bound_key", "_bounds", "_heads", "_step")


def _bounds(df: DataFrame, key: str, order: list[str], rows_per_slice: int) -> DataFrame:
    """(key, sorted bounds, the first bound of each run of ``_step`` bounds): a lookup reads two short arrays."""
    per = min(_SAMPLED_PER_SLICE, max(1, rows_per_slice))
    picked = F.pmod(F.xxhash64(key, *order), F.lit(max(1, rows_per_slice // per))) == 0
    sample = df.where(picked & F.col(order[0]).isNotNull()).select(F.col(key).alias("_bound_key"), F.col(order[0]).alias("_v"))
    nth = F.row_number().over(Window.partitionBy("_bound_key").orderBy("_v"))
    bounds = (sample.withColumn("_nth", nth).where(F.col("_nth") % per == 0)
              .groupBy("_bound_key").agg(F.sort_array(F.collect_set("_v")).alias("_bounds")))
    step = F.ceil(F.sqrt(F.size("_bounds"))).cast("int")
    heads = F.transform(F.sequence(F.lit(1), F.size("_bounds"), F.col("_step")), lambda i: F.element_at("_bounds", i))
    return bounds.withColumn("_step", step).withColumn("_heads", heads)


def _slice_of(value: Column) -> Column:
    def at_or_below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= value))
    first = (at_or_below(F.col("_heads")) - 1) * F.col("_step")   # bounds before the run that can hold the value
    run = F.slice("_bounds", F.greatest(first, F.lit(0)) + 1, F.col("_step"))
    return F.when(first >= 0, first + at_or_below(run)).otherwise(F.lit(0))
