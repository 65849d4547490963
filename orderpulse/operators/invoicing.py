"""Invoices: pricing (A6), the draft and finalize passes (T6), the invoice
finders (P15) and the response view (P16).

Both passes take the billing month as a parameter (no clock) and touch only
that month's rows, so a table partitioned by (billing_year, billing_month)
is rewritten one partition at a time (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import UNLIMITED, base_fee_cents, order_quota
from .metering import MONTH_KEY

INVOICE_COLS = MONTH_KEY + ["plan", "order_count", "webhook_delivery_count", "api_call_count",
                            "amount_cents", "status"]


def amount_cents(plan, orders):
    """Base fee + 1 cent per order above the quota (``>``); ENTERPRISE has none."""
    quota = order_quota(plan)
    over = F.when((plan != "ENTERPRISE") & (orders > quota), orders - quota).otherwise(F.lit(0))
    return (base_fee_cents(plan) + over).cast("bigint")


def invoice_amounts(usage: DataFrame) -> DataFrame:
    """A6 on every usage row: a fresh DRAFT invoice."""
    return usage.select(*MONTH_KEY, "plan", "order_count", "webhook_delivery_count",
                        "api_call_count",
                        amount_cents(F.col("plan"), F.col("order_count")).alias("amount_cents"),
                        F.lit("DRAFT").alias("status"))


def _month(df: DataFrame, year: int, month: int) -> DataFrame:
    return df.filter((F.col("billing_year") == year) & (F.col("billing_month") == month))


def draft_invoices(usage: DataFrame, invoices: DataFrame, year: int, month: int) -> DataFrame:
    """T6 draft pass for one month: the month's invoices after the pass.

    No invoice -> new DRAFT; an existing DRAFT is replaced by fresh counts;
    any other status stays as it is (J10 is the left join on the month key).
    Invoices of tenants without usage that month are kept.
    """
    fresh = invoice_amounts(_month(usage, year, month))
    old = _month(invoices, year, month).select(*MONTH_KEY, *[F.col(c).alias("_o_" + c)
                                                             for c in INVOICE_COLS[3:]])
    j = fresh.join(old, MONTH_KEY, "full")
    keep_old = F.col("_o_status").isNotNull() & ((F.col("_o_status") != "DRAFT")
                                                 | F.col("status").isNull())
    return j.select(*MONTH_KEY, *[F.when(keep_old, F.col("_o_" + c)).otherwise(F.col(c)).alias(c)
                                  for c in INVOICE_COLS[3:]])


def finalize_invoices(usage: DataFrame, invoices: DataFrame, year: int, month: int,
                      refresh: bool = False) -> DataFrame:
    """T6 finalize pass for the given (previous) month.

    DRAFT -> FINALIZED keeping the draft's (possibly stale) counts, or fresh
    counts with ``refresh=True`` (Q7); no invoice -> new, FINALIZED; other
    statuses stay.  Only tenants with usage that month are finalized.
    """
    fresh = invoice_amounts(_month(usage, year, month))
    old = _month(invoices, year, month).select(*MONTH_KEY, *[F.col(c).alias("_o_" + c)
                                                             for c in INVOICE_COLS[3:]])
    j = fresh.join(old, MONTH_KEY, "full")
    has_usage = F.col("status").isNotNull()
    old_draft = F.col("_o_status") == "DRAFT"
    use_old = F.col("_o_status").isNotNull() & (~has_usage | F.lit(not refresh) | ~old_draft)
    cols = [F.when(use_old, F.col("_o_" + c)).otherwise(F.col(c)).alias(c) for c in INVOICE_COLS[3:-1]]
    status = (F.when(~has_usage, F.col("_o_status"))
               .when(F.col("_o_status").isNull() | old_draft, F.lit("FINALIZED"))
               .otherwise(F.col("_o_status")))
    return j.select(*MONTH_KEY, *cols, status.alias("status"))


def previous_month(year: int, month: int) -> tuple[int, int]:
    """F7 for a parameter month."""
    return (year - 1, 12) if month == 1 else (year, month - 1)


def previous_month_of(ts: Column) -> list[Column]:
    """F7 as columns: year and month of the month before an instant."""
    before = F.add_months(F.trunc(ts, "month"), -1)
    return [F.year(before).alias("billing_year"), F.month(before).alias("billing_month")]


def invoice_history(invoices: DataFrame, tenant_id: str, status: str | None = None) -> DataFrame:
    """A tenant's invoices, newest month first, optionally by status."""
    df = invoices.filter(F.col("tenant_id") == tenant_id)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.col("billing_year").desc(), F.col("billing_month").desc())


def invoice_view(invoices: DataFrame) -> DataFrame:
    """Amount in dollars as decimal(20,2)."""
    return invoices.select(*MONTH_KEY, "plan", "order_count", "amount_cents",
                           (F.col("amount_cents").cast("decimal(20,0)") / 100)
                           .cast("decimal(20,2)").alias("amount_usd"), "status")


__all__ = ["invoice_amounts", "draft_invoices", "finalize_invoices", "invoice_history",
           "invoice_view", "previous_month", "amount_cents", "write_month", "UNLIMITED"]


def write_month(invoices_month: DataFrame, path: str) -> None:
    """Store one pass's result: only the (year, month) partitions present in the
    frame are replaced (dynamic partition overwrite); other months stay."""
    (invoices_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("billing_year", "billing_month").parquet(path))
