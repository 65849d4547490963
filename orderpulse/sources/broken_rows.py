"""Rows of the stored tables derived from ``events``, of which some break each constraint once or more.

``SELECTS`` holds each column as text that Spark and DuckDB both read.  What a row breaks follows from
``event_id % 60``; the other rows are sound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table


def _col(name: str, base: str, **broken: int | tuple[int, str]) -> str:
    """``base`` but null for one remainder (``null=``) and other text for others (``x=(remainder, text)``)."""
    cases = "".join(f" WHEN {n} THEN NULL" if isinstance(n, int) else f" WHEN {n[0]} THEN {n[1]}" for n in broken.values())
    return f"CASE event_id % 60{cases} ELSE {base} END AS {name}" if cases else f"{base} AS {name}"


_TEXT = "CAST(event_id AS STRING)"
_ID = _col("id", _TEXT, null=0, same=(1, "'same'"))
_TENANT = _col("tenant_id", "CAST(event_id % 25 AS STRING)", null=2, long=(3, "repeat('t', 65)"))
_TIMES = (_col("created_at", "ts", null=4), _col("updated_at", "ts", null=5))
_PLAN = _col("plan", "'PRO'", null=6, long=(7, "repeat('P', 17)"), other=(8, "'LEGACY'"))
_MONTH = (_ID, _col("tenant_id", f"'t' || {_TEXT}", null=2, long=(3, "repeat('t', 65)"), twin=(9, "'twin'"), twin2=(13, "'twin'")), _PLAN,
          _col("billing_year", "2024", null=10), _col("billing_month", "CAST(event_id % 12 + 1 AS INT)", null=11, twin=(9, "7"), twin2=(13, "7")),
          _col("order_count", "event_id", null=12), _col("webhook_delivery_count", "event_id", null=14), _col("api_call_count", "0", null=15))

SELECTS: dict[str, tuple[str, ...]] = {
    "orders": (_ID, _TENANT, _col("customer_id", "CAST(user_id AS STRING)", null=20, long=(21, "repeat('c', 65)")),
               _col("product_id", "props", null=22, long=(23, "repeat('p', 65)")), _col("quantity", "CAST(event_id % 5 + 1 AS INT)", null=24, zero=(25, "0")),
               _col("amount", "CAST(event_id % 90 + 1 AS DECIMAL(12, 2))", null=26, less=(27, "CAST(-1 AS DECIMAL(12, 2))")),
               _col("currency", "'USD'", null=28, long=(29, "'EURO'")),
               _col("status", "'PLACED'", null=30, long=(31, "repeat('S', 17)"), other=(32, "'SHIPPED'")), _TIMES[0]),
    "outbox": (_ID, _TENANT, _col("aggregate_type", "'Order'", null=20, long=(21, "repeat('a', 65)")),
               _col("aggregate_id", _TEXT, null=22, long=(23, "repeat('a', 65)")), _col("topic", "'orders.placed'", null=24, long=(25, "repeat('t', 129)")),
               _col("event_type", "'OrderPlaced'", null=26, long=(27, "repeat('e', 65)")), _col("payload", "props", null=28), _TIMES[0],
               _col("retry_count", "0", null=29), _col("last_error", "'timeout'", null=30, long=(31, "repeat('x', 513)"))),
    "usage_records": (*_MONTH, *_TIMES),
    "invoices": (*_MONTH, _col("amount_cents", "event_id * 10", null=20),
                 _col("status", "'DRAFT'", null=30, long=(31, "repeat('S', 17)"), other=(32, "'OPEN'")), *_TIMES),
    "tenants": (_ID, _col("slug", f"'s' || {_TEXT}", null=20, long=(21, f"repeat('s', 64) || {_TEXT}"), same=(22, "'acme'")),
                _col("name", f"'n' || {_TEXT}", null=23, long=(24, "repeat('n', 256)")), _PLAN,
                _col("status", "'ACTIVE'", null=30, long=(31, "repeat('S', 17)"), other=(32, "'PAUSED'")),
                _col("api_key", f"'k' || {_TEXT}", null=33, long=(34, f"repeat('k', 64) || {_TEXT}"), same=(35, "'key'")), *_TIMES),
    "webhook_endpoints": (_ID, _col("tenant_id", "CAST(event_id % 25 AS STRING)", null=2), _col("url", "'https://h/' || props", null=20),
                          _col("secret", "'s' || props", null=21), _col("event_types", "'order.placed'", null=22),
                          _col("status", "'ACTIVE'", null=30, other=(32, "'PAUSED'")), *_TIMES),
    "webhook_deliveries": (_ID, _col("endpoint_id", "CAST(event_id % 50 + 1 AS STRING)", null=20, unknown=(21, "'nowhere'")),
                           _col("tenant_id", "CAST(event_id % 25 AS STRING)", null=2), _col("event_type", "'order.placed'", null=22),
                           _col("event_id", _TEXT, null=23), _col("payload", "props", null=24),
                           _col("status", "'PENDING'", null=30, other=(32, "'LOST'")), _col("attempt_count", "0", null=25), *_TIMES),
}


def broken_rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*SELECTS[table])
