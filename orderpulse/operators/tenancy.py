"""Tenants: row isolation (P7-P9), effective tenant (P10), the request gate
(P11), registry finders (P12, P13), API-key resolution (J4), registration
with unique slugs (J8) and status commands (T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import parse_plan
from .orders import blank


def tenant_rows(df: DataFrame, current_tenant: str | None) -> DataFrame:
    """Rows of the current tenant only; no current tenant -> no rows.

    ``=`` against a null literal is null, so an unset tenant selects nothing,
    as the row-security policy does; Catalyst folds that to an empty scan.
    """
    return df.filter(F.col("tenant_id") == F.lit(current_tenant).cast("string"))


# The tenant enums and column sizes of the tenants table.
TENANT_PLANS = ("FREE", "STARTER", "PRO", "ENTERPRISE")
TENANT_STATUSES = ("ACTIVE", "SUSPENDED", "DELETED")
SLUG_MAX, NAME_MAX, API_KEY_MAX = 63, 255, 64


def tenant_constraint_violations(tenants: DataFrame) -> DataFrame:
    """P3 on the tenant registry: NOT NULL, lengths, enum values, unique slug and key."""
    from .orders import table_violations
    rules = [
        ("slug_not_null", F.col("slug").isNull()),
        ("slug_length", F.coalesce(F.length("slug") > SLUG_MAX, F.lit(False))),
        ("name_not_null", F.col("name").isNull()),
        ("name_length", F.coalesce(F.length("name") > NAME_MAX, F.lit(False))),
        ("plan_enum", ~F.coalesce(F.col("plan").isin(*TENANT_PLANS), F.lit(False))),
        ("status_enum", ~F.coalesce(F.col("status").isin(*TENANT_STATUSES), F.lit(False))),
        ("api_key_length", F.coalesce(F.length("api_key") > API_KEY_MAX, F.lit(False))),
    ]
    return table_violations(tenants, "id", rules, ("slug", "api_key"))


def tenant_write_check(df: DataFrame, current_tenant: str | None) -> DataFrame:
    """Mark rows a write as ``current_tenant`` may (not) store."""
    ok = F.coalesce(F.col("tenant_id") == F.lit(current_tenant).cast("string"), F.lit(False))
    return df.withColumn("write_allowed", ok)


def tenant_backfill(df: DataFrame, default: str = "system") -> DataFrame:
    """A missing tenant becomes ``system``."""
    return df.withColumn("tenant_id", F.coalesce(F.col("tenant_id"), F.lit(default)))


def effective_tenant(header: Column, body: Column) -> Column:
    """P10: the header wins when present, else the body field."""
    return F.coalesce(header, body)


def claim_tenant(claim: Column, default: str = "default") -> Column:
    """P10: a user claim when non-blank, else the default tenant."""
    return F.when(~blank(claim), claim).otherwise(F.lit(default))


def _gate_outcome(internal_token: str) -> Column:
    tok_ok = (~blank(F.col("internal_token"))) & (F.col("internal_token") == F.lit(internal_token))
    return (F.when(~blank(F.col("tenant_header")), F.lit("scoped"))
             .when(tok_ok, F.lit("internal"))
             .when(F.col("path").startswith("/actuator"), F.lit("actuator"))
             .otherwise(F.lit("forbidden")))


def request_gate(requests: DataFrame, internal_token: str) -> DataFrame:
    """Classify a request log the way the service filter decides.

    Order: a non-blank tenant header scopes the request; otherwise a matching
    internal token or an ``/actuator`` path passes unscoped; else 403.
    """
    outcome = _gate_outcome(internal_token)
    return requests.select("request_id", "path", "tenant_header", outcome.alias("outcome"),
                           F.when(outcome == "forbidden", F.lit(403)).otherwise(F.lit(200))
                           .alias("http_status"))


def internal_gate(requests: DataFrame, internal_token: str | None) -> DataFrame:
    """P11, the filter behind the tenant filter: with a token configured, a request that passed must carry
    that very token, whatever its tenant header; health probes always pass."""
    configured = internal_token is not None and bool(internal_token.strip())
    first = _gate_outcome(internal_token or "")
    refused = (F.lit(configured) & (first != "forbidden") & ~F.col("path").startswith("/actuator")
               & ~F.col("internal_token").eqNullSafe(F.lit(internal_token)))
    outcome = F.when(refused, F.lit("bad_token")).otherwise(first)
    return requests.select("request_id", "path", "tenant_header", outcome.alias("outcome"),
                           F.when(outcome.isin("forbidden", "bad_token"), F.lit(403)).otherwise(F.lit(200))
                           .alias("http_status"))


def is_active(status: Column) -> Column:
    """F16: active test, case-insensitive."""
    return F.upper(status) == "ACTIVE"


def active_tenants(tenants: DataFrame) -> DataFrame:
    """Tenants whose status is ACTIVE."""
    return tenants.filter(is_active(F.col("status")))


def tenant_by_slug(tenants: DataFrame, slug: str) -> DataFrame:
    """The tenant with this slug (slugs are unique)."""
    return tenants.filter(F.col("slug") == slug)


def tenant_by_id(tenants: DataFrame, tenant_id: str) -> DataFrame:
    """The tenant with this id; no row means not_found."""
    return tenants.filter(F.col("id") == tenant_id)


def tenant_endpoints(endpoints: DataFrame, tenant_id: str, active_only: bool = False) -> DataFrame:
    """Endpoints of a tenant (optionally only ACTIVE ones)."""
    df = endpoints.filter(F.col("tenant_id") == tenant_id)
    return df.filter(F.col("status") == "ACTIVE") if active_only else df


def tenant_endpoint(endpoints: DataFrame, endpoint_id: str, tenant_id: str) -> DataFrame:
    """An endpoint by id, only within the tenant; no row means not_found."""
    return endpoints.filter((F.col("id") == endpoint_id) & (F.col("tenant_id") == tenant_id))


def resolve_api_keys(requests: DataFrame, tenants: DataFrame,
                     inactive_as_invalid: bool = False) -> DataFrame:
    """missing_key / invalid_key / inactive / ok with tenant and plan.

    The tenant registry is a dimension table keyed by a unique api_key; the
    join is an equi left join that the planner broadcasts when the registry
    is measured small and sort-merges otherwise.  With
    ``inactive_as_invalid`` an inactive tenant reads as an unknown key, as the
    registry's active-only lookup makes it in the reference.
    """
    t = tenants.select(F.col("api_key").alias("_key"), F.col("id").alias("_tid"),
                       F.col("plan").alias("_plan"), F.col("status").alias("_status"))
    j = requests.join(t, requests["api_key"] == t["_key"], "left")
    inactive = F.lit("invalid_key") if inactive_as_invalid else F.lit("inactive")
    outcome = (F.when(F.col("path").startswith("/actuator"), F.lit("pass"))
                .when(blank(F.col("api_key")), F.lit("missing_key"))
                .when(F.col("_key").isNull(), F.lit("invalid_key"))
                .when(F.col("_status") != "ACTIVE", inactive)
                .otherwise(F.lit("ok")))
    ok = outcome == "ok"
    return j.select("request_id", "api_key", outcome.alias("outcome"),
                    F.when(ok, F.col("_tid")).alias("tenant_id"),
                    F.when(ok, F.col("_plan")).alias("plan"))


def register_tenants(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Create tenants with unique slugs.

    A slug already in the registry is a conflict (anti join), as is every
    request after the first valid one for the same slug inside the batch.  Plans
    default to FREE.  The first request per slug is a partial ``min``
    aggregate joined back on the slug, so many copies of one slug are
    combined map-side instead of being ranked in one task.
    """
    taken = existing.select(F.col("slug").alias("_slug")).distinct()
    invalid = blank(F.col("slug")) | blank(F.col("name"))
    firsts = requests.filter(~invalid).groupBy("slug").agg(F.min("request_seq").alias("_first_seq"))
    j = (requests.join(firsts, "slug", "left")
                 .join(taken, F.col("slug") == F.col("_slug"), "left"))
    outcome = (F.when(invalid, F.lit("invalid"))
                .when(F.col("_slug").isNotNull(), F.lit("conflict"))
                .when(F.col("request_seq") == F.col("_first_seq"), F.lit("created"))
                .otherwise(F.lit("conflict")))
    plan = F.coalesce(F.upper(F.col("plan")), F.lit("FREE"))
    return j.select("request_seq", "slug", "name", plan.alias("plan"), outcome.alias("outcome"))


def apply_status_commands(entities: DataFrame, commands: DataFrame, id_col: str = "id") -> DataFrame:
    """T5: the latest status command and the latest rename per id win; ids
    that only appear in commands are not_found.

    ``max_by`` is a partial aggregate (bounded state per key), so a flood of
    commands for one id is combined map-side.
    """
    seq = F.col("seq")
    is_status = F.col("command").isin("suspend", "reactivate", "disable")
    latest = commands.groupBy(id_col).agg(
        F.max_by("command", F.when(is_status, seq)).alias("_cmd"),
        F.max_by("arg", F.when(F.col("command") == "rename", seq)).alias("_name"))
    status_of = (F.when(F.col("_cmd") == "suspend", F.lit("SUSPENDED"))
                  .when(F.col("_cmd") == "reactivate", F.lit("ACTIVE"))
                  .when(F.col("_cmd") == "disable", F.lit("DISABLED"))
                  .otherwise(F.col("status")))
    name_of = F.coalesce(F.col("_name"), F.col("name"))
    j = entities.join(latest, id_col, "full")
    found = F.col("status").isNotNull()
    return j.select(id_col,
                    F.when(found, name_of).alias("name"),
                    F.when(found, status_of).otherwise(F.lit("not_found")).alias("status"))


__all__ = ["tenant_rows", "tenant_write_check", "tenant_backfill", "effective_tenant",
           "claim_tenant", "request_gate", "active_tenants", "tenant_by_slug", "tenant_by_id", "tenant_endpoints",
           "resolve_api_keys", "register_tenants", "apply_status_commands", "is_active", "parse_plan"]
