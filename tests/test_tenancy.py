"""Tenancy examples of the reference tests."""
from pyspark.sql import functions as F

from orderpulse.operators import tenancy as ten

TEN = "id string, slug string, name string, plan string, status string, api_key string"


def _tenants(spark):
    return spark.createDataFrame([("tenant-1", "t1", "T1", "PRO", "ACTIVE", "valid-key"),
                                  ("tenant-3", "t3", "T3", "FREE", "ACTIVE", "routing-key"),
                                  ("tenant-2", "t2", "T2", "PRO", "SUSPENDED", "suspended-key")], TEN)


def test_api_key_resolution(spark):
    req = spark.createDataFrame([(1, "valid-key", "/api/orders"), (2, "routing-key", "/api/orders"),
                                 (3, "suspended-key", "/api/orders"), (4, "nope", "/api/orders"),
                                 (5, None, "/api/orders"), (6, None, "/actuator/health")],
                                "request_id long, api_key string, path string")
    got = {r.request_id: (r.outcome, r.tenant_id) for r in ten.resolve_api_keys(req, _tenants(spark)).collect()}
    assert got == {1: ("ok", "tenant-1"), 2: ("ok", "tenant-3"), 3: ("inactive", None), 4: ("invalid_key", None),
                   5: ("missing_key", None), 6: ("pass", None)}
    folded = ten.resolve_api_keys(req, _tenants(spark), inactive_as_invalid=True)
    assert folded.filter("request_id = 3").first().outcome == "invalid_key"


def test_request_gate(spark):
    req = spark.createDataFrame([(1, "/api/orders", "t1", None), (2, "/api/orders", None, None),
                                 (3, "/api/orders", None, "tok"), (4, "/actuator/health", None, None),
                                 (5, "/api/orders", " ", "bad")],
                                "request_id long, path string, tenant_header string, internal_token string")
    got = {r.request_id: (r.outcome, r.http_status) for r in ten.request_gate(req, "tok").collect()}
    assert got == {1: ("scoped", 200), 2: ("forbidden", 403), 3: ("internal", 200), 4: ("actuator", 200),
                   5: ("forbidden", 403)}


def test_row_isolation(spark):
    df = spark.createDataFrame([("o1", "tenant-a"), ("o2", "tenant-b"), ("o3", None)], "order_id string, tenant_id string")
    assert [r.order_id for r in ten.tenant_rows(df, "tenant-a").collect()] == ["o1"]
    assert ten.tenant_rows(df, None).count() == 0
    assert {r.order_id: r.write_allowed for r in ten.tenant_write_check(df, "tenant-b").collect()} == \
        {"o1": False, "o2": True, "o3": False}
    assert {r.order_id: r.tenant_id for r in ten.tenant_backfill(df).collect()}["o3"] == "system"


def test_unique_slugs(spark):
    reqs = spark.createDataFrame([(1, "acme-corp", "Acme", None), (2, "duplicate-slug", "D", "pro"),
                                  (3, "duplicate-slug", "D2", None), (4, "t1", "x", None), (5, "", "x", None)],
                                 "request_seq long, slug string, name string, plan string")
    got = {r.request_seq: (r.outcome, r.plan) for r in ten.register_tenants(reqs, _tenants(spark)).collect()}
    assert got == {1: ("created", "FREE"), 2: ("created", "PRO"), 3: ("conflict", "FREE"),
                   4: ("conflict", "FREE"), 5: ("invalid", "FREE")}


def test_status_commands(spark):
    cmds = spark.createDataFrame([("tenant-1", "suspend", None, 1), ("tenant-1", "rename", "New", 2),
                                  ("tenant-2", "reactivate", None, 1), ("ghost", "suspend", None, 1)],
                                 "id string, command string, arg string, seq long")
    t = _tenants(spark).select("id", "name", "status")
    got = {r.id: (r.name, r.status) for r in ten.apply_status_commands(t, cmds).collect()}
    assert got == {"tenant-1": ("New", "SUSPENDED"), "tenant-2": ("T2", "ACTIVE"), "tenant-3": ("T3", "ACTIVE"),
                   "ghost": (None, "not_found")}


def test_active_is_case_insensitive(spark):
    t = spark.createDataFrame([("a", "active"), ("b", "SUSPENDED")], "id string, status string")
    assert [r.id for r in ten.active_tenants(t).collect()] == ["a"]
