"""Registry of the named queries: one Spark plan and, where SQL can say it,
one independent DuckDB oracle per key.

Queries return only bigint, double, string and boolean columns so results
compare across engines: decimals become doubles, instants epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str


QUERIES: dict[str, Query] = {}


_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "UTC+0", "Etc/UCT", "UCT"}


def ensure_utc(spark: SparkSession) -> None:
    """The reference keeps every instant in UTC (months are UTC months); the
    queries read ``timestamp_ntz`` columns as UTC instants, which needs a UTC
    session time zone."""
    if spark.conf.get("spark.sql.session.timeZone") not in _UTC_NAMES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(key: str, oracle: str | None, ids: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            ensure_utc(spark)
            ship_package(spark)
            return to_contract(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        QUERIES[key] = Query(key, build, oracle, ids)
        return fn
    return deco


def to_contract(df: DataFrame) -> DataFrame:
    """Cast every column to bigint / double / string / boolean."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(t, T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            c = F.to_json(c) if not isinstance(t, T.BinaryType) else F.base64(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_all() -> dict[str, Query]:
    from . import queries  # noqa: F401  (registers on import)
    return QUERIES
