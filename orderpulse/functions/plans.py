"""Plan tiers and their limits.

Each table is a literal map column, so a lookup is a JVM expression that
stays inside whole-stage codegen; no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLANS = ("FREE", "STARTER", "PRO", "ENTERPRISE")
UNLIMITED = 2147483647

# Monthly order quota per plan.
ORDER_QUOTA = {"FREE": 100, "STARTER": 2000, "PRO": 20000, "ENTERPRISE": UNLIMITED}
# Monthly webhook delivery quota per plan.
WEBHOOK_QUOTA = {"FREE": 0, "STARTER": 500, "PRO": 10000, "ENTERPRISE": UNLIMITED}
# Monthly base fee in cents per plan.
BASE_FEE_CENTS = {"FREE": 0, "STARTER": 2900, "PRO": 9900, "ENTERPRISE": 49900}
# Gateway requests per minute per plan (unknown plan -> 100,
# ENTERPRISE is not limited).
RATE_LIMIT = {"FREE": 100, "STARTER": 500, "PRO": 2000}
RATE_LIMIT_DEFAULT = 100
# The second, unused requests-per-minute table.
RATE_LIMIT_ALT = {"ENTERPRISE": 1000, "PRO": 500}
RATE_LIMIT_ALT_DEFAULT = 100


def lookup(table: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    v = F.element_at(m, key)
    return v if default is None else F.coalesce(v, F.lit(default))


def parse_plan(plan: Column) -> Column:
    """upper-case; unknown (and null) plans become FREE."""
    up = F.upper(plan)
    return F.when(up.isin(*PLANS), up).otherwise(F.lit("FREE"))


def order_quota(plan: Column) -> Column:
    return lookup(ORDER_QUOTA, plan).cast("bigint")


def webhook_quota(plan: Column) -> Column:
    return lookup(WEBHOOK_QUOTA, plan).cast("bigint")


def base_fee_cents(plan: Column) -> Column:
    return lookup(BASE_FEE_CENTS, plan).cast("bigint")


def rate_limit(plan: Column) -> Column:
    """T2 limit per request; null means not limited (ENTERPRISE)."""
    return (F.when(plan == "ENTERPRISE", F.lit(None).cast("bigint"))
             .otherwise(lookup(RATE_LIMIT, plan, RATE_LIMIT_DEFAULT).cast("bigint")))


def rate_limit_alt(plan: Column) -> Column:
    """the alternative table (ENTERPRISE 1000, PRO 500, else 100)."""
    return lookup(RATE_LIMIT_ALT, plan, RATE_LIMIT_ALT_DEFAULT).cast("bigint")
