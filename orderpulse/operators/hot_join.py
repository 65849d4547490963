"""A left join of many rows with a table of one row for each key, when a few keys hold most rows.

Keys with more than their share of the rows are counted first (a partial aggregate: one row for each key and task); they are
fewer than ``MAX_HOT_KEYS``, so their side of the table is broadcast and their rows stay where they are.  All others are joined on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, MAX_HOT_KEYS = 1000, 10_000


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` that has their ``key`` (null where there is none)."""
    counts = rows.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    many = max(HOT_ROWS, total // MAX_HOT_KEYS)
    hot = counts.where(F.col("_n") > many).select("_hot_key")
    hot_table = table.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_semi")
    is_hot = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_semi")
    others = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left_anti")
    return is_hot.join(F.broadcast(hot_table), key, "left").unionByName(others.join(table, key, "left"))
