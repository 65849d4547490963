"""P3 for the stored tables: declared constraints, and a compiler from a declaration to one job.

A table's declaration lists its columns (required, length, allowed values, positive) and its keys of
one or more columns.  ``violations`` gives a row for each row and rule it breaks.  Everything a row can
tell by itself is one projection; each key adds a partial count whose repeated keys are joined back,
and each reference a join with the distinct keys referred to.  Rows are narrowed to their id, the rules
they break and the key columns before any join, so payloads are never shuffled.  A key whose copies are
a third of all rows is one row of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .orders import failed_rules


@dataclass(frozen=True)
class Field:
    """What a column may hold.  Rules other than ``required`` hold for a null."""

    name: str
    longest: int | None = None
    allowed: tuple[str, ...] = ()
    positive: bool = False
    required: bool = True

    def rules(self) -> list[tuple[str, Column]]:
        c, no = F.col(self.name), F.lit(False)
        out = [(f"{self.name}_null", c.isNull())] if self.required else []
        if self.longest is not None:
            out.append((f"{self.name}_too_long", F.coalesce(F.length(c) > self.longest, no)))
        if self.allowed:
            out.append((f"{self.name}_not_allowed", F.coalesce(~c.isin(*self.allowed), no)))
        if self.positive:
            out.append((f"{self.name}_not_positive", F.coalesce(c <= 0, no)))
        return out


@dataclass(frozen=True)
class Table:
    """A table's columns, keys (name -> columns) and references (column -> key column of another table)."""

    fields: tuple[Field, ...]
    keys: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"id": ("id",)})
    references: dict[str, str] = field(default_factory=dict)


# The stored enums.
PLANS = ("FREE", "STARTER", "PRO", "ENTERPRISE")
ORDER_STATUSES = ("PLACED", "CONFIRMED", "REJECTED")
INVOICE_STATUSES = ("DRAFT", "FINALIZED", "PAID", "VOID")
DELIVERY_STATUSES = ("PENDING", "DELIVERED", "FAILED", "EXHAUSTED")
ENDPOINT_STATUSES = ("ACTIVE", "DISABLED")
TENANT_STATUSES = ("ACTIVE", "SUSPENDED", "DELETED")


def _required(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n) for n in names)


_TIMES = _required("created_at", "updated_at")
_MONTH = (Field("id"), Field("tenant_id", 64), Field("plan", 16, PLANS), *_required("billing_year", "billing_month"),
          *_required("order_count", "webhook_delivery_count", "api_call_count"))
_MONTH_KEYS = {"id": ("id",), "tenant_month": ("tenant_id", "billing_year", "billing_month")}

# Lengths, CHECKs and keys of the stored tables.
TABLES: dict[str, Table] = {
    "orders": Table((Field("id"), Field("tenant_id", 64), Field("customer_id", 64), Field("product_id", 64),
                     Field("quantity", positive=True), Field("amount", positive=True), Field("currency", 3),
                     Field("status", 16, ORDER_STATUSES), Field("created_at"))),
    "outbox": Table((Field("id"), Field("tenant_id", 64), Field("aggregate_type", 64), Field("aggregate_id", 64),
                     Field("topic", 128), Field("event_type", 64), Field("payload"), Field("created_at"),
                     Field("retry_count"), Field("last_error", 512, required=False))),
    "usage_records": Table((*_MONTH, *_TIMES), _MONTH_KEYS),
    "invoices": Table((*_MONTH, Field("amount_cents"), Field("status", 16, INVOICE_STATUSES), *_TIMES), _MONTH_KEYS),
    "tenants": Table((Field("id"), Field("slug", 63), Field("name", 255), Field("plan", 16, PLANS),
                      Field("status", 16, TENANT_STATUSES), Field("api_key", 64), *_TIMES),
                     {"id": ("id",), "slug": ("slug",), "api_key": ("api_key",)}),
    "webhook_endpoints": Table((*_required("id", "tenant_id", "url", "secret", "event_types"),
                                Field("status", allowed=ENDPOINT_STATUSES), *_TIMES)),
    "webhook_deliveries": Table((*_required("id", "endpoint_id", "tenant_id", "event_type", "event_id", "payload"),
                                 Field("status", allowed=DELIVERY_STATUSES), Field("attempt_count"), *_TIMES),
                                references={"endpoint_id": "id"}),
}


def violations(rows: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None, id_col: str = "id") -> DataFrame:
    """(``id_col``, rule) for each row and rule it breaks; a row that breaks nothing gives none.

    A key with a null column repeats nothing, as in a unique index; every copy of a repeated key is
    reported.  ``parents`` has the table for each column in ``table.references``; a null refers to nothing.
    """
    rules = [r for f in table.fields for r in f.rules()]
    key_cols = {c for cols in table.keys.values() for c in cols} | set(table.references)
    narrow = rows.select(F.col(id_col).alias("_id"), failed_rules(rules).alias("_broken"),
                         *[F.col(c).alias(f"_key_{c}") for c in sorted(key_cols)])
    for name, cols in table.keys.items():
        narrow = _add_rule(narrow, _repeated(narrow, cols), [f"_key_{c}" for c in cols], f"{name}_repeated", found=True)
    for col, parent_key in table.references.items():
        known = parents[col].where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("_of0")).distinct()
        narrow = _add_rule(narrow, known, [f"_key_{col}"], f"{col}_unknown", found=False)
    return narrow.select(F.col("_id").alias(id_col), F.explode("_broken").alias("rule"))


def _repeated(narrow: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    whole = narrow
    for c in cols:
        whole = whole.where(F.col(f"_key_{c}").isNotNull())
    names = [F.col(f"_key_{c}").alias(f"_of{i}") for i, c in enumerate(cols)]
    return whole.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def _add_rule(narrow: DataFrame, keys: DataFrame, cols: list[str], rule: str, found: bool) -> DataFrame:
    """``rule`` added to the rows whose ``cols`` are (``found``) or are not among ``keys``; rows with a null are left alone."""
    on = [F.col(c) == F.col(f"_of{i}") for i, c in enumerate(cols)]
    whole = [F.col(c).isNotNull() for c in cols]
    j = narrow.join(keys.withColumn("_hit", F.lit(True)), on, "left")
    breaks = (F.col("_hit").isNotNull() if found else F.col("_hit").isNull())
    for w in whole:
        breaks = breaks & w
    return j.withColumn("_broken", F.when(breaks, F.concat("_broken", F.array(F.lit(rule)))).otherwise(F.col("_broken"))) \
            .drop("_hit", *[f"_of{i}" for i in range(len(cols))])
