"""A global row number without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row to one
task.  Here the rows are range-partitioned and sorted, each partition numbers
its own rows (``monotonically_increasing_id`` encodes partition and local
index), and the start offset of each partition comes from a table of
per-partition counts - one row per partition, so joining it by broadcast is
bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ordered_fold import range_partitions

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or range_partitions(df)
    parted = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                .checkpoint(eager=True))
    counts = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)
    return (parted.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.col("_off") + local + 1)
                  .drop("_mid", "_pid", "_off"))


def global_running_max(df: DataFrame, order: list[str], value: str, name: str = "running_max",
                       num_partitions: int | None = None) -> DataFrame:
    """``df`` with the greatest ``value`` up to and including each row in ``order`` (unique per row).

    Rows are cut into ranges; a range runs its own maximum and takes the greatest value of all
    ranges before it from a table with a row for each range."""
    ensure_checkpoint_dir(df.sparkSession)
    n = num_partitions or range_partitions(df)
    parted = (df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    tops = parted.groupBy("_pid").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_pid", F.max("_top").over(before).alias("_carried"))
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parted.withColumn("_own", F.max(value).over(own))
    return (rows.join(F.broadcast(carried), "_pid")
                .withColumn(name, F.greatest("_own", "_carried")).drop("_pid", "_own", "_carried"))
