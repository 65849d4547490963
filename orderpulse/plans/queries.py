"""Named queries over the driver's tables, each with a DuckDB oracle.

Every query reads whole tables (through the adapter views) and returns the
full result; parameters such as "current tenant" or "billing month" are
fixed values below, not data caps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import invoicing as inv
from ..operators import metering as met
from ..operators import orders as ords
from ..operators import saga as sg
from ..operators import tenancy as ten
from ..operators.reserve import stock_reservation
from ..sources import tables as tb
from .catalog import register
from .oracle_views import N_ADDRESSED, N_TENANTS, with_views as W

# Fixed query parameters.
CUSTOMER = "8"
TENANT = "3"
TENANT_HISTORY = "2"
SLUG = "nation_3"
INTERNAL_TOKEN = tb.INTERNAL_TOKEN
CHECK_YEAR, CHECK_MONTH = 1998, 8
DRAFT_YEAR, DRAFT_MONTH = 1996, 6

# --------------------------------------------------------------------------
# Shared oracle fragments
# --------------------------------------------------------------------------
T1_SQL = """
t1_o AS (
  SELECT order_id, product_id, quantity,
         row_number() OVER (PARTITION BY product_id ORDER BY placed_at, order_id) AS rn
  FROM v_orders),
t1 AS (
  SELECT product_id, rn, order_id, quantity,
         CASE WHEN quantity <= 100 THEN 'RESERVED' ELSE 'OUT_OF_STOCK' END AS status,
         CASE WHEN quantity <= 100 THEN 100 - quantity ELSE 100 END AS remaining
  FROM t1_o WHERE rn = 1
  UNION ALL
  SELECT o.product_id, o.rn, o.order_id, o.quantity,
         CASE WHEN o.quantity <= t1.remaining THEN 'RESERVED' ELSE 'OUT_OF_STOCK' END,
         CASE WHEN o.quantity <= t1.remaining THEN t1.remaining - o.quantity ELSE t1.remaining END
  FROM t1 JOIN t1_o o ON o.product_id = t1.product_id AND o.rn = t1.rn + 1)"""

COMPLETION_SQL = T1_SQL + """,
comp AS (
  SELECT o.order_id,
         CASE WHEN o.amount <= 1000.00 AND t1.status = 'RESERVED' THEN 'CONFIRMED' ELSE 'REJECTED' END AS status,
         CASE WHEN o.amount <= 1000.00 AND t1.status = 'RESERVED' THEN NULL
              WHEN o.amount > 1000.00 THEN 'payment_declined' ELSE 'out_of_stock' END AS reason,
         o.placed_at AS completed_at, o.correlation_id, o.tenant_id,
         CASE WHEN o.amount > 1000.00 THEN 'DECLINED' ELSE 'APPROVED' END AS payment_status,
         t1.status AS inventory_status
  FROM v_orders o JOIN t1 ON o.order_id = t1.order_id)"""

BLANK = "({c} IS NULL OR NOT regexp_matches({c}, '\\S'))"

LINES_USAGE_SQL = """
usage AS (
  SELECT u.tenant_id, u.billing_year, u.billing_month, u.order_count,
         CAST(0 AS BIGINT) AS webhook_delivery_count, CAST(0 AS BIGINT) AS api_call_count,
         CASE WHEN upper(coalesce(t.plan, 'FREE')) IN ('FREE','STARTER','PRO','ENTERPRISE')
              THEN upper(coalesce(t.plan, 'FREE')) ELSE 'FREE' END AS plan
  FROM (SELECT tenant_id, CAST(year(placed_at) AS BIGINT) AS billing_year,
               CAST(month(placed_at) AS BIGINT) AS billing_month, count(*) AS order_count
        FROM v_lines WHERE NOT (tenant_id IS NULL OR NOT regexp_matches(tenant_id, '\\S'))
        GROUP BY ALL) u
  LEFT JOIN v_tenants t ON u.tenant_id = t.id)"""

QUOTA_CASE = ("CASE {p} WHEN 'FREE' THEN 100 WHEN 'STARTER' THEN 2000 WHEN 'PRO' THEN 20000 "
              "ELSE 2147483647 END")
FEE_CASE = "CASE {p} WHEN 'FREE' THEN 0 WHEN 'STARTER' THEN 2900 WHEN 'PRO' THEN 9900 ELSE 49900 END"
AMOUNT_SQL = ("CAST(" + FEE_CASE.format(p="plan") + " + CASE WHEN plan <> 'ENTERPRISE' AND order_count > "
              + QUOTA_CASE.format(p="plan") + " THEN order_count - " + QUOTA_CASE.format(p="plan")
              + " ELSE 0 END AS BIGINT)")

INVOICES_SQL = LINES_USAGE_SQL + f""",
inv_all AS (
  SELECT tenant_id, billing_year, billing_month, plan, order_count, webhook_delivery_count,
         api_call_count, {AMOUNT_SQL} AS amount_cents, 'DRAFT' AS status FROM usage)"""

# Existing invoices before the T6 passes (ours): tenants 0 and 1 hold a DRAFT
# made from half the orders, tenant 2 a FINALIZED one, tenant 3 a PAID one,
# tenant 4 none.
EXISTING_SQL = """
old_inv AS (
  SELECT tenant_id, billing_year, billing_month, plan, order_count // 2 AS order_count,
         webhook_delivery_count, api_call_count, amount_cents // 2 AS amount_cents,
         CASE tenant_id WHEN '0' THEN 'DRAFT' WHEN '1' THEN 'DRAFT' WHEN '2' THEN 'FINALIZED'
              ELSE 'PAID' END AS status
  FROM inv_all WHERE tenant_id <> '4')"""


def _existing_invoices(spark, d):
    usage = met.monthly_usage(tb.order_line_counts(spark, d), tb.tenants(spark, d), weight_col="lines")
    a = inv.invoice_amounts(usage).filter(F.col("tenant_id") != "4")
    status = (F.when(F.col("tenant_id").isin("0", "1"), F.lit("DRAFT"))
               .when(F.col("tenant_id") == "2", F.lit("FINALIZED")).otherwise(F.lit("PAID")))
    return usage, a.select(*met.MONTH_KEY, "plan", F.floor(F.col("order_count") / 2).cast("bigint")
                           .alias("order_count"), "webhook_delivery_count", "api_call_count",
                           F.floor(F.col("amount_cents") / 2).cast("bigint").alias("amount_cents"),
                           status.alias("status"))


# --------------------------------------------------------------------------
# Saga: P1, T1, J1, J2, J3
# --------------------------------------------------------------------------
@register("payment_decision", W("""
SELECT order_id, substr(sha256('payment:' || order_id), 1, 32) AS payment_id,
       CASE WHEN amount > 1000.00 THEN 'DECLINED' ELSE 'APPROVED' END AS status,
       CAST(amount AS DOUBLE) AS amount, epoch_us(placed_at) AS processed_at, correlation_id, tenant_id
FROM v_orders""", "v_orders"), "P1")
def q_payment_decision(spark, d):
    return sg.payment_decision(tb.orders_stream(spark, d))


@register("stock_reservation", W("WITH RECURSIVE " + T1_SQL + """
SELECT order_id, product_id, CAST(quantity AS BIGINT) AS quantity, status,
       CAST(remaining AS BIGINT) AS remaining FROM t1""", "v_orders"), "T1, W1")
def q_stock_reservation(spark, d):
    r = stock_reservation(tb.orders_stream(spark, d))
    return r.select("order_id", "product_id", "quantity", "status", "remaining")


_COMP_COLS = ("order_id, status, reason, epoch_us(completed_at) AS completed_at, correlation_id, "
              "tenant_id, payment_status, inventory_status")


# Reservations arrive up to 7 minutes late (ours), so some lie beyond the join's 5 minutes.
@register("order_completion", W("WITH RECURSIVE " + COMPLETION_SQL + f""",
late AS (SELECT c.* REPLACE (o.placed_at + to_minutes(o.seq % 8) AS completed_at), o.placed_at AS processed_at
         FROM comp c JOIN v_orders o ON o.order_id = c.order_id)
SELECT {_COMP_COLS} FROM late
WHERE completed_at BETWEEN processed_at - INTERVAL 5 MINUTE AND processed_at + INTERVAL 5 MINUTE""",
                                "v_orders"), "J1, P1, T1")
def q_order_completion(spark, d):
    o = tb.orders_stream(spark, d)
    wait = F.make_dt_interval(mins=(F.col("order_id").cast("bigint") % 8).cast("int"))
    late = sg.reservations(o).withColumn("reserved_at", F.col("reserved_at") + wait)
    return sg.order_completion(sg.payment_decision(o), late)


# Reservations arrive up to 14 minutes after their own time (ours); what is late by then completes nothing.
@register("order_completion_no_grace", W("WITH RECURSIVE " + COMPLETION_SQL + f""",
facts AS (
  SELECT order_id, 'payment' AS side, placed_at AS "at", placed_at AS arrived_at FROM v_orders
  UNION ALL SELECT order_id, 'reservation', placed_at, placed_at + to_minutes(seq % 8 * 2) FROM v_orders),
seen AS (SELECT *, max("at") OVER (ORDER BY arrived_at, side, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time FROM facts),
timely AS (SELECT order_id, side FROM seen WHERE "at" >= stream_time - INTERVAL 5 MINUTE)
SELECT {_COMP_COLS} FROM comp WHERE (SELECT count(*) FROM timely t WHERE t.order_id = comp.order_id) = 2""", "v_orders"), "J1")
def q_order_completion_no_grace(spark, d):
    o = tb.orders_stream(spark, d, keep_seq=True)
    wait = F.make_dt_interval(mins=(F.col("order_id").cast("bigint") % 8 * 2).cast("int"))
    late = sg.reservations(o).withColumn("arrived_at", F.col("reserved_at") + wait)
    return sg.completion_no_grace(sg.payment_decision(o).withColumn("arrived_at", F.col("processed_at")), late)


@register("saga_summary", W("WITH RECURSIVE " + COMPLETION_SQL + """
SELECT status, reason, count(*) AS n_orders FROM comp GROUP BY status, reason""", "v_orders"),
          "P1, T1, J1")
def q_saga_summary(spark, d):
    return sg.saga_summary(sg.saga(tb.orders_stream(spark, d)))


@register("order_status", W("WITH RECURSIVE " + COMPLETION_SQL + """
SELECT o.order_id, o.tenant_id, o.customer_id, o.product_id, CAST(o.quantity AS BIGINT) AS quantity,
       CAST(o.amount AS DOUBLE) AS amount, coalesce(c.status, 'PLACED') AS status,
       epoch_us(coalesce(c.completed_at, o.placed_at)) AS updated_at
FROM v_orders o LEFT JOIN comp c ON o.order_id = c.order_id""", "v_orders"), "J2")
def q_order_status(spark, d):
    o = tb.orders_stream(spark, d)
    return sg.order_status(o, sg.saga(o))


@register("customer_feed", W("WITH RECURSIVE " + COMPLETION_SQL + """
SELECT o.customer_id, c.order_id, c.status, c.reason, epoch_us(c.completed_at) AS completed_at, c.tenant_id
FROM comp c JOIN v_orders o ON o.order_id = c.order_id""", "v_orders"), "J3")
def q_customer_feed(spark, d):
    o = tb.orders_stream(spark, d)
    return sg.customer_feed(sg.saga(o), o)


# --------------------------------------------------------------------------
# Orders: P2-P6, S5, P21, J9
# --------------------------------------------------------------------------
_ORDER_FAILED = ("concat_ws(',', "
                 f"CASE WHEN {BLANK.format(c='tenant_id')} THEN 'tenant_id_blank' END, "
                 f"CASE WHEN {BLANK.format(c='customer_id')} THEN 'customer_id_blank' END, "
                 f"CASE WHEN {BLANK.format(c='product_id')} THEN 'product_id_blank' END, "
                 f"CASE WHEN {BLANK.format(c='currency')} THEN 'currency_blank' END, "
                 "CASE WHEN coalesce(quantity <= 0, true) THEN 'quantity_not_positive' END, "
                 "CASE WHEN coalesce(amount <= 0, true) THEN 'amount_not_positive' END)")


@register("validate_orders", W(f"""
SELECT order_id, {_ORDER_FAILED} = '' AS valid, {_ORDER_FAILED} AS failed FROM v_requests_bad""",
                               "v_requests_bad"), "P2")
def q_validate_orders(spark, d):
    return ords.validate_orders(tb.bad_requests(spark, d)).select("order_id", "valid", "failed")


_EP_FAILED = ("concat_ws(',', "
              f"CASE WHEN {BLANK.format(c='tenant_id')} THEN 'tenant_id_blank' END, "
              "CASE WHEN NOT coalesce(regexp_full_match(url, 'https?://.+'), false) THEN 'url_pattern' END, "
              "CASE WHEN coalesce(length(secret) < 16, true) THEN 'secret_too_short' END, "
              f"CASE WHEN {BLANK.format(c='event_types')} THEN 'event_types_blank' END)")


@register("validate_endpoints", W(f"""
SELECT id, {_EP_FAILED} = '' AS valid, {_EP_FAILED} AS failed FROM v_endpoint_requests""",
                                  "v_endpoint_requests"), "P2, F12")
def q_validate_endpoints(spark, d):
    from ..functions.text import url_ok
    rules = [("tenant_id_blank", ords.blank(F.col("tenant_id"))),
             ("url_pattern", ~F.coalesce(url_ok(F.col("url")), F.lit(False))),
             ("secret_too_short", F.coalesce(F.length("secret") < 16, F.lit(True))),
             ("event_types_blank", ords.blank(F.col("event_types")))]
    return ords.validate(tb.endpoint_requests(spark, d), rules).select("id", "valid", "failed")


@register("constraint_violations", W("""
SELECT order_id, concat_ws(',',
         CASE WHEN coalesce(quantity <= 0, false) THEN 'quantity_check' END,
         CASE WHEN coalesce(amount <= 0, false) THEN 'amount_check' END,
         CASE WHEN tenant_id IS NULL THEN 'tenant_not_null' END,
         CASE WHEN product_id IS NULL THEN 'product_not_null' END,
         CASE WHEN coalesce(length(currency) > 3, false) THEN 'currency_length' END,
         CASE WHEN count(*) OVER (PARTITION BY order_id) > 1 THEN 'duplicate_key' END) AS violations
FROM v_requests_bad
QUALIFY violations <> ''""", "v_requests_bad"), "P3")
def q_constraint_violations(spark, d):
    return ords.constraint_violations(tb.bad_requests(spark, d))


_ORDER_COLS = ("order_id, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity, "
               "CAST(amount AS DOUBLE) AS amount, epoch_us(placed_at) AS placed_at")


@register("orders_by_customer", W(f"SELECT {_ORDER_COLS} FROM v_orders WHERE customer_id = '{CUSTOMER}'",
                                  "v_orders"), "P4, L3")
def q_orders_by_customer(spark, d):
    return ords.orders_by_customer(tb.orders_stream(spark, d), CUSTOMER).select(
        "order_id", "customer_id", "product_id", "quantity", "amount", "placed_at")


@register("orders_by_tenant_customer", W(f"""
SELECT {_ORDER_COLS} FROM v_orders WHERE tenant_id = '{CUSTOMER}' AND customer_id = '{CUSTOMER}'""",
                                         "v_orders"), "P5")
def q_orders_by_tenant_customer(spark, d):
    return ords.orders_by_tenant_customer(tb.orders_stream(spark, d), CUSTOMER, CUSTOMER).select(
        "order_id", "customer_id", "product_id", "quantity", "amount", "placed_at")


@register("order_lookup", W("""
SELECT l.lookup_id, l.order_id, l.caller,
       CASE WHEN o.customer_id IS NULL THEN 'not_found'
            WHEN l.caller IS NOT NULL AND l.caller <> o.customer_id THEN 'forbidden' ELSE 'ok' END AS outcome
FROM v_lookups l LEFT JOIN v_orders o ON l.order_id = o.order_id""", "v_lookups", "v_orders"), "P6")
def q_order_lookup(spark, d):
    return ords.order_lookup(tb.order_lookups(spark, d), tb.orders_stream(spark, d))


@register("place_orders", W(f"""
SELECT order_id, tenant_id, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity,
       CAST(amount AS DOUBLE) AS amount, currency, 'PLACED' AS status, epoch_us(placed_at) AS created_at
FROM v_requests_bad WHERE {_ORDER_FAILED} = ''""", "v_requests_bad"), "S5")
def q_place_orders(spark, d):
    return ords.place_orders(tb.bad_requests(spark, d))[0]


@register("place_orders_outbox", W(f"""
SELECT 'ob-' || order_id AS id, 'Order' AS aggregate_type, order_id AS aggregate_id,
       'orders.placed' AS topic, 'OrderPlaced' AS event_type,
       to_base64(encode('{{"orderId":"' || order_id || '","customerId":"' || customer_id
             || '","productId":"' || product_id || '","quantity":' || CAST(quantity AS VARCHAR)
             || ',"amount":"' || CAST(amount AS VARCHAR) || '","currency":"' || currency
             || '","placedAt":' || CAST(epoch_us(placed_at) // 1000 AS VARCHAR) || ',"correlationId":"' || correlation_id
             || '","tenantId":"' || tenant_id || '"}}')) AS payload,
       epoch_us(placed_at) AS created_at, tenant_id
FROM v_requests_bad WHERE {_ORDER_FAILED} = ''""", "v_requests_bad"), "S5, F13")
def q_place_orders_outbox(spark, d):
    return ords.place_orders(tb.bad_requests(spark, d))[1]


@register("order_lines_display", W("""
SELECT order_id, substr(order_id, 1, 8) AS short_id,
       printf('%.2f %s', CAST(amount AS DOUBLE), currency) AS amount_text FROM v_orders""", "v_orders"),
          "P21")
def q_order_lines_display(spark, d):
    return ords.order_lines_display(tb.orders_stream(spark, d))


@register("order_totals", W("""
SELECT o.order_id, o.product_id, CAST(o.quantity AS BIGINT) AS quantity, c.price,
       c.price * o.quantity AS total, c.price * o.quantity > 1000 AS warn
FROM v_orders o JOIN v_catalog c ON o.product_id = c.product_id""", "v_orders", "v_catalog"), "J9")
def q_order_totals(spark, d):
    return ords.order_totals(tb.orders_stream(spark, d), tb.catalog(spark, d))


# --------------------------------------------------------------------------
# Tenancy: P7-P13, J4, J8, T5, F2, F16
# --------------------------------------------------------------------------
@register("tenant_rows", W(f"SELECT order_id, tenant_id FROM v_orders WHERE tenant_id = '{TENANT}'",
                           "v_orders"), "P7")
def q_tenant_rows(spark, d):
    return ten.tenant_rows(tb.orders_stream(spark, d), TENANT).select("order_id", "tenant_id")


@register("tenant_rows_unset", W("SELECT order_id, tenant_id FROM v_orders WHERE tenant_id = NULL",
                                 "v_orders"), "P7")
def q_tenant_rows_unset(spark, d):
    return ten.tenant_rows(tb.orders_stream(spark, d), None).select("order_id", "tenant_id")


@register("tenant_write_check", W(f"""
SELECT order_id, tenant_id, coalesce(tenant_id = '{TENANT}', false) AS write_allowed
FROM v_requests_bad""", "v_requests_bad"), "P8")
def q_tenant_write_check(spark, d):
    return ten.tenant_write_check(tb.bad_requests(spark, d), TENANT).select(
        "order_id", "tenant_id", "write_allowed")


@register("tenant_backfill", W("""
SELECT order_id, coalesce(tenant_id, 'system') AS tenant_id FROM v_requests_bad""", "v_requests_bad"),
          "P9")
def q_tenant_backfill(spark, d):
    return ten.tenant_backfill(tb.bad_requests(spark, d)).select("order_id", "tenant_id")


@register("effective_tenant", W("""
SELECT order_id,
       coalesce(CASE WHEN seq % 4 = 0 THEN NULL ELSE tenant_id END, 'body-' || customer_id) AS effective_tenant,
       CASE WHEN NOT (tenant_id IS NULL OR NOT regexp_matches(tenant_id, '\\S')) THEN tenant_id ELSE 'default' END AS claim_tenant
FROM v_requests_bad""", "v_requests_bad"), "P10")
def q_effective_tenant(spark, d):
    r = tb.bad_requests(spark, d)
    header = F.when(F.col("seq") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("tenant_id"))
    return r.select("order_id",
                    ten.effective_tenant(header, F.concat(F.lit("body-"), F.col("customer_id")))
                    .alias("effective_tenant"),
                    ten.claim_tenant(F.col("tenant_id")).alias("claim_tenant"))


@register("request_gate", W(f"""
SELECT request_id, path, tenant_header,
       CASE WHEN NOT {BLANK.format(c='tenant_header')} THEN 'scoped'
            WHEN NOT {BLANK.format(c='internal_token')} AND internal_token = '{INTERNAL_TOKEN}' THEN 'internal'
            WHEN starts_with(path, '/actuator') THEN 'actuator' ELSE 'forbidden' END AS outcome,
       CASE WHEN NOT {BLANK.format(c='tenant_header')} THEN 200
            WHEN NOT {BLANK.format(c='internal_token')} AND internal_token = '{INTERNAL_TOKEN}' THEN 200
            WHEN starts_with(path, '/actuator') THEN 200 ELSE 403 END AS http_status
FROM v_requests""", "v_requests"), "P11")
def q_request_gate(spark, d):
    return ten.request_gate(tb.requests_log(spark, d), INTERNAL_TOKEN)


@register("internal_gate", W(f"""
SELECT request_id, path, tenant_header,
       CASE WHEN starts_with(path, '/actuator') AND {BLANK.format(c='tenant_header')}
                 AND internal_token IS DISTINCT FROM '{INTERNAL_TOKEN}' THEN 'actuator'
            WHEN starts_with(path, '/actuator') OR internal_token = '{INTERNAL_TOKEN}'
              THEN CASE WHEN {BLANK.format(c='tenant_header')} THEN 'internal' ELSE 'scoped' END
            WHEN {BLANK.format(c='tenant_header')} THEN 'forbidden' ELSE 'bad_token' END AS outcome,
       CASE WHEN starts_with(path, '/actuator') OR coalesce(internal_token = '{INTERNAL_TOKEN}', false)
            THEN 200 ELSE 403 END AS http_status
FROM v_requests""", "v_requests"), "P11")
def q_internal_gate(spark, d):
    return ten.internal_gate(tb.requests_log(spark, d), INTERNAL_TOKEN)


@register("active_tenants", W("SELECT id, slug, plan, status FROM v_tenants WHERE upper(status) = 'ACTIVE'",
                              "v_tenants"), "P12, F16")
def q_active_tenants(spark, d):
    return ten.active_tenants(tb.tenants(spark, d)).select("id", "slug", "plan", "status")


@register("tenant_by_slug", W(f"SELECT id, slug, plan, status FROM v_tenants WHERE slug = '{SLUG}'",
                              "v_tenants"), "P12")
def q_tenant_by_slug(spark, d):
    return ten.tenant_by_slug(tb.tenants(spark, d), SLUG).select("id", "slug", "plan", "status")


@register("tenant_by_id", W(f"SELECT id, slug, plan, status FROM v_tenants WHERE id = '{TENANT}'",
                            "v_tenants"), "P12")
def q_tenant_by_id(spark, d):
    return ten.tenant_by_id(tb.tenants(spark, d), TENANT).select("id", "slug", "plan", "status")


@register("tenant_constraint_violations", W("""
SELECT id, concat_ws(',',
         CASE WHEN slug IS NULL THEN 'slug_not_null' END,
         CASE WHEN coalesce(length(slug) > 63, false) THEN 'slug_length' END,
         CASE WHEN name IS NULL THEN 'name_not_null' END,
         CASE WHEN coalesce(length(name) > 255, false) THEN 'name_length' END,
         CASE WHEN NOT coalesce(plan IN ('FREE','STARTER','PRO','ENTERPRISE'), false) THEN 'plan_enum' END,
         CASE WHEN NOT coalesce(status IN ('ACTIVE','SUSPENDED','DELETED'), false) THEN 'status_enum' END,
         CASE WHEN coalesce(length(api_key) > 64, false) THEN 'api_key_length' END,
         CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN 'duplicate_slug' END,
         CASE WHEN count(*) OVER (PARTITION BY api_key) > 1 THEN 'duplicate_api_key' END) AS violations
FROM v_tenants QUALIFY violations <> ''""", "v_tenants"), "P3")
def q_tenant_constraint_violations(spark, d):
    return ten.tenant_constraint_violations(tb.tenants(spark, d))


@register("tenant_endpoints", W(f"""
SELECT id, tenant_id, url, status FROM v_endpoints WHERE tenant_id = '{TENANT}'""", "v_endpoints"), "P13")
def q_tenant_endpoints(spark, d):
    return ten.tenant_endpoints(tb.endpoints(spark, d), TENANT).select("id", "tenant_id", "url", "status")


@register("tenant_endpoint", W(f"""
SELECT id, tenant_id, url, status FROM v_endpoints WHERE id = '28' AND tenant_id = '{TENANT}'""", "v_endpoints"), "P13")
def q_tenant_endpoint(spark, d):
    return ten.tenant_endpoint(tb.endpoints(spark, d), "28", TENANT).select("id", "tenant_id", "url", "status")


@register("invoice_month", W("""
SELECT DISTINCT CAST(year(p) AS BIGINT) AS billing_year, CAST(month(p) AS BIGINT) AS billing_month
FROM (SELECT date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS p FROM orders)"""), "F7")
def q_invoice_month(spark, d):
    from ..operators.invoicing import previous_month_of
    return tb.read_table(spark, d, "orders").select(*previous_month_of(F.col("o_orderdate"))).distinct()


@register("tenant_active_endpoints", W(f"""
SELECT id, tenant_id, url, status FROM v_endpoints WHERE tenant_id = '{TENANT}' AND status = 'ACTIVE'""",
                                       "v_endpoints"), "P13")
def q_tenant_active_endpoints(spark, d):
    return ten.tenant_endpoints(tb.endpoints(spark, d), TENANT, active_only=True).select(
        "id", "tenant_id", "url", "status")


@register("resolve_api_keys", W("""
SELECT r.request_id, r.api_key,
       CASE WHEN starts_with(r.path, '/actuator') THEN 'pass'
            WHEN r.api_key IS NULL OR NOT regexp_matches(r.api_key, '\\S') THEN 'missing_key'
            WHEN t.api_key IS NULL THEN 'invalid_key'
            WHEN t.status <> 'ACTIVE' THEN 'inactive' ELSE 'ok' END AS outcome,
       CASE WHEN NOT starts_with(r.path, '/actuator') AND t.status = 'ACTIVE' THEN t.id END AS tenant_id,
       CASE WHEN NOT starts_with(r.path, '/actuator') AND t.status = 'ACTIVE' THEN t.plan END AS plan
FROM v_requests r LEFT JOIN v_tenants t ON r.api_key = t.api_key""", "v_requests", "v_tenants"), "J4")
def q_resolve_api_keys(spark, d):
    return ten.resolve_api_keys(tb.requests_log(spark, d), tb.tenants(spark, d))


def _tenant_requests(spark, d):
    c = tb.read_table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("request_seq"),
                    F.concat(F.lit("nation_"), (k % 30).cast("string")).alias("slug"),
                    F.when(k % 30 == k, F.lit("\t \n")).otherwise(F.col("c_name")).alias("name"),
                    F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.lit("pro"))
                    .otherwise(F.lit("starter")).alias("plan"))


@register("register_tenants", W("""
WITH req AS (
  SELECT c_custkey AS request_seq, 'nation_' || CAST(c_custkey % 30 AS VARCHAR) AS slug,
         CASE WHEN c_custkey < 30 THEN chr(9) || ' ' || chr(10) ELSE c_name END AS name,
         CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'pro' ELSE 'starter' END AS plan
  FROM customer)
SELECT r.request_seq, r.slug, r.name, coalesce(upper(r.plan), 'FREE') AS plan,
       CASE WHEN r.slug IS NULL OR NOT regexp_matches(r.slug, '\\S') OR r.name IS NULL OR NOT regexp_matches(r.name, '\\S') THEN 'invalid'
            WHEN EXISTS (SELECT 1 FROM v_tenants t WHERE t.slug = r.slug) THEN 'conflict'
            WHEN r.request_seq = min(CASE WHEN regexp_matches(r.slug, '\\S') AND regexp_matches(r.name, '\\S') THEN r.request_seq END)
                                  OVER (PARTITION BY r.slug) THEN 'created'
            ELSE 'conflict' END AS outcome
FROM req r""", "v_tenants"), "J8")
def q_register_tenants(spark, d):
    return ten.register_tenants(_tenant_requests(spark, d), tb.tenants(spark, d))


def _tenant_commands(spark, d):
    ev = tb.read_table(spark, d, "events")
    e = F.col("event_id")
    cmd = (F.when(e % 4 == 0, F.lit("suspend")).when(e % 4 == 1, F.lit("reactivate"))
            .when(e % 4 == 2, F.lit("rename")).otherwise(F.lit("suspend")))
    return ev.select((F.col("user_id") % 30).cast("string").alias("id"), cmd.alias("command"),
                     F.concat(F.lit("renamed-"), e.cast("string")).alias("arg"), e.alias("seq"))


@register("tenant_status", W("""
WITH cmd AS (
  SELECT CAST(user_id % 30 AS VARCHAR) AS id,
         CASE event_id % 4 WHEN 0 THEN 'suspend' WHEN 1 THEN 'reactivate' WHEN 2 THEN 'rename'
              ELSE 'suspend' END AS command,
         'renamed-' || CAST(event_id AS VARCHAR) AS arg, event_id AS seq
  FROM events),
latest AS (
  SELECT id, arg_max(command, seq) FILTER (WHERE command IN ('suspend','reactivate','disable')) AS cmd,
         arg_max(arg, seq) FILTER (WHERE command = 'rename') AS new_name
  FROM cmd GROUP BY id)
SELECT coalesce(t.id, l.id) AS id,
       CASE WHEN t.status IS NOT NULL THEN coalesce(l.new_name, t.name) END AS name,
       CASE WHEN t.status IS NULL THEN 'not_found'
            WHEN l.cmd = 'suspend' THEN 'SUSPENDED' WHEN l.cmd = 'reactivate' THEN 'ACTIVE'
            WHEN l.cmd = 'disable' THEN 'DISABLED' ELSE t.status END AS status
FROM v_tenants t FULL JOIN latest l ON t.id = l.id""", "v_tenants"), "T5")
def q_tenant_status(spark, d):
    return ten.apply_status_commands(tb.tenants(spark, d).select("id", "name", "status"),
                                     _tenant_commands(spark, d))


@register("parse_plan", W("""
SELECT id, plan AS raw_plan,
       CASE WHEN upper(plan) IN ('FREE','STARTER','PRO','ENTERPRISE') THEN upper(plan) ELSE 'FREE' END AS plan
FROM v_tenants""", "v_tenants"), "F2")
def q_parse_plan(spark, d):
    from ..functions.plans import parse_plan
    t = tb.tenants(spark, d)
    return t.select("id", F.col("plan").alias("raw_plan"), parse_plan(F.col("plan")).alias("plan"))


# --------------------------------------------------------------------------
# Metering and invoicing: A1, A4, A6, T6, P15, P16
# --------------------------------------------------------------------------
_USAGE_COLS = ("tenant_id, billing_year, billing_month, plan, order_count, webhook_delivery_count, "
               "api_call_count")


def _usage(spark, d):
    # lines counted per order before the join (same counts as counting v_lines)
    return met.monthly_usage(tb.order_line_counts(spark, d), tb.tenants(spark, d), weight_col="lines")


@register("monthly_usage", W("WITH " + LINES_USAGE_SQL + f"\nSELECT {_USAGE_COLS} FROM usage",
                             "v_lines", "v_tenants"), "A1, F6, P19")
def q_monthly_usage(spark, d):
    return _usage(spark, d).select(*_USAGE_COLS.split(", "))


@register("order_quota", W("WITH " + LINES_USAGE_SQL + f"""
SELECT t.id AS tenant_id, CAST({CHECK_YEAR} AS BIGINT) AS billing_year,
       CAST({CHECK_MONTH} AS BIGINT) AS billing_month, t.plan AS requested_plan,
       coalesce(u.order_count, 0) AS used,
       CAST({QUOTA_CASE.format(p="CASE WHEN upper(t.plan) IN ('FREE','STARTER','PRO','ENTERPRISE') THEN upper(t.plan) ELSE 'FREE' END")} AS BIGINT) AS quota_limit,
       coalesce(u.order_count >= {QUOTA_CASE.format(p="u.plan")}, false) AS exceeded
FROM v_tenants t LEFT JOIN usage u
  ON u.tenant_id = t.id AND u.billing_year = {CHECK_YEAR} AND u.billing_month = {CHECK_MONTH}""",
                           "v_lines", "v_tenants"), "A4")
def q_order_quota(spark, d):
    checks = tb.tenants(spark, d).select(
        F.col("id").alias("tenant_id"), F.lit(CHECK_YEAR).alias("billing_year"),
        F.lit(CHECK_MONTH).alias("billing_month"), "plan")
    return met.order_quota_check(checks, _usage(spark, d))


@register("usage_view", W("WITH " + LINES_USAGE_SQL + f"""
SELECT {_USAGE_COLS}, CAST({QUOTA_CASE.format(p='plan')} AS BIGINT) AS order_quota,
       order_count >= {QUOTA_CASE.format(p='plan')} AS order_quota_exceeded FROM usage""",
                          "v_lines", "v_tenants"), "P16")
def q_usage_view(spark, d):
    return met.usage_view(_usage(spark, d))


@register("usage_history", W("WITH " + LINES_USAGE_SQL + f"""
SELECT {_USAGE_COLS} FROM usage WHERE tenant_id = '{TENANT_HISTORY}'""", "v_lines", "v_tenants"),
          "P15, L3")
def q_usage_history(spark, d):
    return met.usage_history(_usage(spark, d), TENANT_HISTORY).select(*_USAGE_COLS.split(", "))


_INV_COLS = _USAGE_COLS + ", amount_cents, status"


@register("invoice_amounts", W("WITH " + INVOICES_SQL + f"\nSELECT {_INV_COLS} FROM inv_all",
                               "v_lines", "v_tenants"), "A6")
def q_invoice_amounts(spark, d):
    return inv.invoice_amounts(_usage(spark, d))


@register("invoice_totals", W("WITH " + INVOICES_SQL + """
SELECT tenant_id, plan, sum(amount_cents) AS amount_cents, count(*) AS months
FROM inv_all GROUP BY tenant_id, plan""", "v_lines", "v_tenants"), "A6")
def q_invoice_totals(spark, d):
    a = inv.invoice_amounts(_usage(spark, d))
    return a.groupBy("tenant_id", "plan").agg(F.sum("amount_cents").alias("amount_cents"),
                                              F.count(F.lit(1)).alias("months"))


@register("draft_invoices", W("WITH " + INVOICES_SQL + "," + EXISTING_SQL + f""",
fresh AS (SELECT * FROM inv_all WHERE billing_year = {DRAFT_YEAR} AND billing_month = {DRAFT_MONTH}),
old AS (SELECT * FROM old_inv WHERE billing_year = {DRAFT_YEAR} AND billing_month = {DRAFT_MONTH})
SELECT coalesce(f.tenant_id, o.tenant_id) AS tenant_id, coalesce(f.billing_year, o.billing_year) AS billing_year,
       coalesce(f.billing_month, o.billing_month) AS billing_month,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.plan ELSE f.plan END AS plan,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.order_count ELSE f.order_count END AS order_count,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.webhook_delivery_count ELSE f.webhook_delivery_count END AS webhook_delivery_count,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.api_call_count ELSE f.api_call_count END AS api_call_count,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.amount_cents ELSE f.amount_cents END AS amount_cents,
       CASE WHEN o.status IS NOT NULL AND (o.status <> 'DRAFT' OR f.status IS NULL) THEN o.status ELSE f.status END AS status
FROM fresh f FULL JOIN old o USING (tenant_id, billing_year, billing_month)""", "v_lines", "v_tenants"),
          "T6, J10")
def q_draft_invoices(spark, d):
    usage, existing = _existing_invoices(spark, d)
    return inv.draft_invoices(usage, existing, DRAFT_YEAR, DRAFT_MONTH)


_FIN_YEAR, _FIN_MONTH = inv.previous_month(DRAFT_YEAR, DRAFT_MONTH)


@register("finalize_invoices", W("WITH " + INVOICES_SQL + "," + EXISTING_SQL + f""",
fresh AS (SELECT * FROM inv_all WHERE billing_year = {_FIN_YEAR} AND billing_month = {_FIN_MONTH}),
old AS (SELECT * FROM old_inv WHERE billing_year = {_FIN_YEAR} AND billing_month = {_FIN_MONTH})
SELECT coalesce(f.tenant_id, o.tenant_id) AS tenant_id, coalesce(f.billing_year, o.billing_year) AS billing_year,
       coalesce(f.billing_month, o.billing_month) AS billing_month,
       coalesce(o.plan, f.plan) AS plan, coalesce(o.order_count, f.order_count) AS order_count,
       coalesce(o.webhook_delivery_count, f.webhook_delivery_count) AS webhook_delivery_count,
       coalesce(o.api_call_count, f.api_call_count) AS api_call_count,
       coalesce(o.amount_cents, f.amount_cents) AS amount_cents,
       CASE WHEN f.status IS NULL THEN o.status
            WHEN o.status IS NULL OR o.status = 'DRAFT' THEN 'FINALIZED' ELSE o.status END AS status
FROM fresh f FULL JOIN old o USING (tenant_id, billing_year, billing_month)""", "v_lines", "v_tenants"),
          "T6, F7, Q7")
def q_finalize_invoices(spark, d):
    usage, existing = _existing_invoices(spark, d)
    return inv.finalize_invoices(usage, existing, _FIN_YEAR, _FIN_MONTH)


@register("invoice_history", W("WITH " + INVOICES_SQL + f"""
SELECT {_INV_COLS} FROM inv_all WHERE tenant_id = '{TENANT_HISTORY}'""", "v_lines", "v_tenants"), "P15")
def q_invoice_history(spark, d):
    return inv.invoice_history(inv.invoice_amounts(_usage(spark, d)), TENANT_HISTORY)


@register("invoice_view", W("WITH " + INVOICES_SQL + """
SELECT tenant_id, billing_year, billing_month, plan, order_count, amount_cents,
       CAST(CAST(amount_cents AS DECIMAL(20,0)) / 100 AS DOUBLE) AS amount_usd, status FROM inv_all""",
                            "v_lines", "v_tenants"), "P16")
def q_invoice_view(spark, d):
    return inv.invoice_view(inv.invoice_amounts(_usage(spark, d)))


# --------------------------------------------------------------------------
# Rate limit: T2, F15
# --------------------------------------------------------------------------
T2_SQL = """
r0 AS (
  SELECT request_id, tenant_id, req_ms,
         CAST(CASE plan WHEN 'ENTERPRISE' THEN NULL WHEN 'STARTER' THEN 500 WHEN 'PRO' THEN 2000
              ELSE 100 END AS BIGINT) AS rate_limit,
         row_number() OVER (PARTITION BY tenant_id ORDER BY req_ms, ts, request_id) AS rn
  FROM v_requests WHERE tenant_id IS NOT NULL AND plan <> 'ENTERPRISE' AND NOT starts_with(path, '/actuator')),
rl AS (
  SELECT tenant_id, rn, request_id, req_ms AS window_start, CAST(1 AS BIGINT) AS request_count
  FROM r0 WHERE rn = 1
  UNION ALL
  SELECT o.tenant_id, o.rn, o.request_id,
         CASE WHEN o.req_ms - rl.window_start > 60000 THEN o.req_ms ELSE rl.window_start END,
         CASE WHEN o.req_ms - rl.window_start > 60000 THEN 1 ELSE rl.request_count + 1 END
  FROM rl JOIN r0 o ON o.tenant_id = rl.tenant_id AND o.rn = rl.rn + 1),
decided AS (
  SELECT r0.request_id, r0.tenant_id, r0.rate_limit, rl.window_start, rl.request_count,
         rl.request_count <= r0.rate_limit AS allowed,
         CASE WHEN rl.request_count <= r0.rate_limit THEN greatest(0, r0.rate_limit - rl.request_count) END
           AS remaining
  FROM r0 JOIN rl USING (request_id)
  UNION ALL
  SELECT request_id, tenant_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), true,
         CAST(NULL AS BIGINT)
  FROM v_requests WHERE tenant_id IS NULL OR plan = 'ENTERPRISE' OR starts_with(path, '/actuator'))"""


def _rate(spark, d):
    from ..operators.ratelimit import rate_limit_decisions
    return rate_limit_decisions(tb.requests_log(spark, d))


@register("rate_limit", W("WITH RECURSIVE " + T2_SQL + """
SELECT request_id, tenant_id, rate_limit, window_start, request_count, allowed, remaining FROM decided""",
                          "v_requests"), "T2, F9")
def q_rate_limit(spark, d):
    return _rate(spark, d).select("request_id", "tenant_id", "rate_limit", "window_start",
                                  "request_count", "allowed", "remaining")


@register("rate_limit_summary", W("WITH RECURSIVE " + T2_SQL + """
SELECT tenant_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS refused
FROM decided GROUP BY tenant_id""", "v_requests"), "T2")
def q_rate_limit_summary(spark, d):
    r = _rate(spark, d)
    return r.groupBy("tenant_id").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"),
                                      F.count(F.when(~F.col("allowed"), 1)).alias("refused"))


@register("rate_limit_alt", W("""
SELECT request_id, tenant_id, plan,
       CAST(CASE plan WHEN 'ENTERPRISE' THEN 1000 WHEN 'PRO' THEN 500 ELSE 100 END AS BIGINT) AS rate_limit
FROM v_requests""", "v_requests"), "F15")
def q_rate_limit_alt(spark, d):
    from ..functions.plans import rate_limit_alt
    r = tb.requests_log(spark, d)
    return r.select("request_id", "tenant_id", "plan", rate_limit_alt(F.col("plan")).alias("rate_limit"))


# --------------------------------------------------------------------------
# Webhook delivery state machine: T3, P17, J6, J7
# --------------------------------------------------------------------------
NOW = "2024-01-20 00:00:00"
_BACKOFF = "(CASE WHEN {c} >= 3 THEN 300 WHEN {c} = 2 THEN 120 WHEN {c} = 1 THEN 60 ELSE 30 END) * 1000000"
T3_SQL = f"""
a AS (SELECT delivery_id, attempt_id, http_status AS h, error AS e, epoch_us(ts) AS ts_us,
             row_number() OVER (PARTITION BY delivery_id ORDER BY ts, attempt_id) AS rn
      FROM v_attempts),
d AS (
  SELECT DISTINCT delivery_id, CAST(0 AS BIGINT) AS rn, 'PENDING' AS st, 0 AS cnt,
         CAST(NULL AS INTEGER) AS http, CAST(NULL AS VARCHAR) AS err, CAST(NULL AS BIGINT) AS nxt,
         CAST(NULL AS BIGINT) AS dlv, false AS ign
  FROM a
  UNION ALL
  SELECT a.delivery_id, a.rn,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.st
         WHEN a.h IS NULL THEN 'FAILED'
         WHEN a.h BETWEEN 200 AND 299 THEN 'DELIVERED'
         WHEN d.cnt + 1 < 5 THEN 'FAILED' ELSE 'EXHAUSTED' END,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.cnt
         WHEN a.h IS NULL THEN d.cnt + 1
         WHEN a.h BETWEEN 200 AND 299 THEN d.cnt + 1
         WHEN d.cnt + 1 < 5 THEN d.cnt + 2 ELSE d.cnt + 1 END,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.http
         WHEN a.h IS NULL THEN d.http ELSE a.h END,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.err
         WHEN a.h IS NULL THEN a.e
         WHEN a.h BETWEEN 200 AND 299 THEN NULL
         WHEN d.cnt + 1 < 5 THEN 'HTTP ' || CAST(a.h AS VARCHAR) ELSE NULL END,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.nxt
         WHEN a.h IS NULL THEN a.ts_us + {_BACKOFF.format(c='d.cnt')}
         WHEN a.h BETWEEN 200 AND 299 THEN d.nxt
         WHEN d.cnt + 1 < 5 THEN a.ts_us + {_BACKOFF.format(c='(d.cnt + 1)')} ELSE d.nxt END,
    CASE WHEN d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5 THEN d.dlv
         WHEN a.h BETWEEN 200 AND 299 THEN a.ts_us ELSE d.dlv END,
    d.st IN ('DELIVERED','EXHAUSTED') OR d.cnt >= 5
  FROM d JOIN a ON a.delivery_id = d.delivery_id AND a.rn = d.rn + 1),
fin AS (
  SELECT delivery_id, st AS status, CAST(cnt AS BIGINT) AS attempt_count,
         CAST(http AS BIGINT) AS last_http_status, err AS last_error,
         nxt AS next_attempt_at, dlv AS delivered_at,
         (SELECT count(*) FROM d d2 WHERE d2.delivery_id = d.delivery_id AND d2.rn > 0 AND NOT d2.ign)
           AS outcomes_used,
         rn AS outcomes_seen, st = 'FAILED' AND cnt >= 5 AS stuck
  FROM d QUALIFY rn = max(rn) OVER (PARTITION BY delivery_id))"""

# The delivery table as it stood at NOW: only outcomes up to NOW are folded.
T3_ASOF_SQL = T3_SQL.replace("FROM v_attempts),", f"FROM v_attempts WHERE ts <= TIMESTAMP '{NOW}'),")
assert T3_ASOF_SQL != T3_SQL

_DS_COLS = ("delivery_id, status, attempt_count, last_http_status, last_error, next_attempt_at, "
            "delivered_at, outcomes_used, outcomes_seen, stuck")


def _deliveries(spark, d, as_of: str | None = None):
    from ..operators.delivery import delivery_status
    a = tb.attempts(spark, d)
    if as_of is not None:
        a = a.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    return delivery_status(a)


@register("delivery_status", W("WITH RECURSIVE " + T3_SQL + f"\nSELECT {_DS_COLS} FROM fin",
                               "v_attempts"), "T3, F9, Q1, Q2")
def q_delivery_status(spark, d):
    return _deliveries(spark, d).select(*_DS_COLS.split(", "))


@register("delivery_summary", W("WITH RECURSIVE " + T3_SQL + """
SELECT status, stuck, count(*) AS deliveries FROM fin GROUP BY status, stuck""", "v_attempts"), "T3")
def q_delivery_summary(spark, d):
    return _deliveries(spark, d).groupBy("status", "stuck").agg(F.count(F.lit(1)).alias("deliveries"))


@register("due_retries", W("WITH RECURSIVE " + T3_ASOF_SQL + f"""
SELECT {_DS_COLS} FROM fin
WHERE status = 'FAILED' AND (next_attempt_at IS NULL OR next_attempt_at <= epoch_us(TIMESTAMP '{NOW}'))
  AND attempt_count < 5
ORDER BY next_attempt_at NULLS FIRST, delivery_id LIMIT 50""", "v_attempts"), "P17, L2")
def q_due_retries(spark, d):
    from ..operators.delivery import due_retries
    return due_retries(_deliveries(spark, d, NOW), F.lit(NOW).cast("timestamp")).select(
        *_DS_COLS.split(", "))


def _delivery_meta(spark, d):
    a = tb.attempts(spark, d).select("delivery_id").distinct()
    endpoint = F.col("delivery_id") % tb.addressed_endpoints(spark, d)
    return a.select("delivery_id", endpoint.cast("string").alias("endpoint_id"),
                    (endpoint % tb.tenant_count(spark, d)).cast("string").alias("tenant_id"))


_META_SQL = f"""
meta AS (SELECT DISTINCT delivery_id, CAST(delivery_id % {N_ADDRESSED} AS VARCHAR) AS endpoint_id,
                CAST(delivery_id % {N_ADDRESSED} % {N_TENANTS} AS VARCHAR) AS tenant_id FROM v_attempts)"""


@register("retry_batch", W("WITH RECURSIVE " + T3_ASOF_SQL + "," + _META_SQL + f"""
SELECT r.delivery_id, r.status, r.attempt_count, m.endpoint_id, e.url, e.status AS endpoint_status
FROM (SELECT * FROM fin
      WHERE status = 'FAILED' AND (next_attempt_at IS NULL OR next_attempt_at <= epoch_us(TIMESTAMP '{NOW}'))
        AND attempt_count < 5
      ORDER BY next_attempt_at NULLS FIRST, delivery_id LIMIT 50) r
JOIN meta m ON m.delivery_id = r.delivery_id JOIN v_endpoints e ON e.id = m.endpoint_id""",
                           "v_attempts", "v_endpoints"), "J6")
def q_retry_batch(spark, d):
    from ..operators.delivery import due_retries, retry_batch
    due = due_retries(_deliveries(spark, d, NOW), F.lit(NOW).cast("timestamp"))
    b = retry_batch(due, _delivery_meta(spark, d), tb.endpoints(spark, d))
    return b.select("delivery_id", "status", "attempt_count", "endpoint_id", "url", "endpoint_status")


@register("endpoint_deliveries", W("WITH " + _META_SQL + """
SELECT m.delivery_id, m.endpoint_id, m.tenant_id FROM meta m
WHERE EXISTS (SELECT 1 FROM v_endpoints e WHERE e.id = m.endpoint_id AND e.id = '7' AND e.tenant_id = '7')""",
                                   "v_attempts", "v_endpoints"), "J7")
def q_endpoint_deliveries(spark, d):
    from ..operators.delivery import endpoint_deliveries
    return endpoint_deliveries(_delivery_meta(spark, d), tb.endpoints(spark, d), "7", "7")


# --------------------------------------------------------------------------
# Outbox: S6, S7, L1, T4, T8, A7, A8
# --------------------------------------------------------------------------
from ..operators import outbox as obx  # noqa: E402

_DECODED_SQL = """
dec AS (
  SELECT id, topic, json_extract_string(CASE WHEN json_valid(js) THEN js ELSE 'null' END, '$.orderId') AS order_id
  FROM (SELECT id, topic, decode(from_base64(payload)) AS js FROM v_outbox))"""


@register("decode_outbox", W("WITH " + _DECODED_SQL + """
SELECT id, topic, order_id IS NOT NULL AS ok, order_id,
       CASE WHEN order_id IS NULL THEN 'undecodable payload' END AS error FROM dec""", "v_outbox"),
          "S6, F13")
def q_decode_outbox(spark, d):
    return obx.decode_outbox(tb.outbox(spark, d))


@register("outbox_events", W("""
SELECT id, topic, js IS NOT NULL AS ok, json_extract_string(js, '$.orderId') AS order_id,
       json_extract_string(js, '$.customerId') AS customer_id, json_extract_string(js, '$.productId') AS product_id,
       CAST(json_extract_string(js, '$.quantity') AS BIGINT) AS quantity, CAST(json_extract_string(js, '$.amount') AS DOUBLE) AS amount,
       json_extract_string(js, '$.currency') AS currency, CAST(json_extract_string(js, '$.placedAt') AS BIGINT) * 1000 AS placed_at,
       json_extract_string(js, '$.correlationId') AS correlation_id, json_extract_string(js, '$.tenantId') AS tenant_id,
       CASE WHEN js IS NULL THEN 'undecodable payload' END AS error
FROM (SELECT id, topic, CASE WHEN json_valid(t) THEN t END AS js FROM (SELECT id, topic, decode(from_base64(payload)) AS t FROM v_outbox))""",
                             "v_outbox"), "S6, F13")
def q_outbox_events(spark, d):
    return obx.outbox_events(tb.outbox(spark, d))


@register("outbox_pending", W("SELECT count(*) FILTER (WHERE processed_at IS NULL) AS pending FROM v_outbox",
                              "v_outbox"), "A7, Q12")
def q_outbox_pending(spark, d):
    return obx.outbox_pending(tb.outbox(spark, d))


@register("outbox_batch", W("""
SELECT id, aggregate_id, epoch_us(created_at) AS created_at FROM v_outbox WHERE processed_at IS NULL
ORDER BY created_at, id LIMIT 100""", "v_outbox"), "L1")
def q_outbox_batch(spark, d):
    return obx.outbox_batch(tb.outbox(spark, d)).select("id", "aggregate_id", "created_at")


@register("outbox_relay", W("""
SELECT id, topic, aggregate_id, row_number() OVER (ORDER BY created_at, id) AS position,
       (row_number() OVER (ORDER BY created_at, id) - 1) // 100 AS cycle
FROM v_outbox WHERE processed_at IS NULL""", "v_outbox"), "S7")
def q_outbox_relay(spark, d):
    return obx.outbox_relay(tb.outbox(spark, d))


@register("outbox_dead_scan", W("""
SELECT id, CAST(retry_count AS BIGINT) AS retry_count, epoch_us(created_at) AS created_at FROM v_outbox
WHERE retry_count >= 5 AND processed_at IS NULL ORDER BY created_at, id LIMIT 10""", "v_outbox"), "T8, L2, Q3")
def q_outbox_dead_scan(spark, d):
    return obx.outbox_dead_scan(tb.outbox(spark, d)).select("id", "retry_count", "created_at")


_T4_SQL = _DECODED_SQL + """,
t4 AS (
  SELECT o.id,
         CASE WHEN o.processed_at IS NOT NULL THEN true ELSE true END AS processed,
         CAST(CASE WHEN o.processed_at IS NOT NULL OR d.order_id IS NOT NULL THEN o.retry_count
                   ELSE o.retry_count + greatest(1, 5 - o.retry_count) END AS BIGINT) AS retry_count,
         CASE WHEN o.processed_at IS NULL AND d.order_id IS NULL THEN 'undecodable payload' END AS last_error,
         o.processed_at IS NULL AND d.order_id IS NULL AS dead,
         epoch_us(CASE WHEN o.processed_at IS NOT NULL THEN o.processed_at
                       WHEN d.order_id IS NOT NULL THEN o.created_at + INTERVAL 1 SECOND
                       ELSE o.created_at + to_seconds(greatest(1, 5 - o.retry_count)) END) AS processed_at
  FROM v_outbox o JOIN dec d ON d.id = o.id)"""


@register("outbox_status", W("WITH " + _T4_SQL + "\nSELECT * FROM t4", "v_outbox"), "T4, F8")
def q_outbox_status(spark, d):
    return obx.outbox_status(tb.outbox(spark, d))


@register("outbox_dead_count", W("WITH " + _T4_SQL + "\nSELECT count(*) FILTER (WHERE dead) AS dead_letters FROM t4",
                                 "v_outbox"), "A8")
def q_outbox_dead_count(spark, d):
    return obx.outbox_dead_count(obx.outbox_status(tb.outbox(spark, d)))


_RELAY_SQL = _DECODED_SQL + """,
out AS (
  SELECT x.*, x.ok AND d.order_id IS NOT NULL AS good,
         CASE WHEN d.order_id IS NULL THEN 'undecodable payload' ELSE substr(x.error, 1, 500) END AS kept,
         row_number() OVER (PARTITION BY event_id ORDER BY "at", outcome_id) AS k
  FROM v_relay_outcomes x JOIN dec d ON d.id = x.event_id),
ends AS (   -- per row: the attempt that succeeds, and the failure that is one too many
  SELECT o.id, o.retry_count, o.processed_at, min(k) FILTER (good) AS success, greatest(1, 5 - o.retry_count) AS limit_k,
         count(k) AS attempts
  FROM v_outbox o LEFT JOIN out ON out.event_id = o.id GROUP BY o.id, o.retry_count, o.processed_at),
used AS (
  SELECT *, CASE WHEN processed_at IS NOT NULL THEN 0
                 ELSE least(attempts, limit_k, coalesce(success, attempts)) END AS used FROM ends),
relayed AS (
  SELECT u.id, u.processed_at IS NOT NULL OR (u.used > 0 AND (u.used = u.success OR u.used = u.limit_k)) AS processed,
         CAST(u.retry_count + u.used - CASE WHEN u.used > 0 AND u.used = u.success THEN 1 ELSE 0 END AS BIGINT) AS retry_count,
         last.kept AS last_error,
         u.used > 0 AND u.used = u.limit_k AND u.used IS DISTINCT FROM u.success AS dead,
         epoch_us(coalesce(u.processed_at, CASE WHEN u.used = u.success OR u.used = u.limit_k THEN fin."at" END)) AS processed_at,
         CAST(u.used AS BIGINT) AS used
  FROM used u LEFT JOIN out fin ON fin.event_id = u.id AND fin.k = u.used
  LEFT JOIN out last ON last.event_id = u.id AND NOT last.good
       AND last.k = u.used - CASE WHEN u.used = u.success THEN 1 ELSE 0 END)"""


@register("relay_status", W("WITH " + _RELAY_SQL + "\nSELECT * FROM relayed", "v_outbox", "v_relay_outcomes"), "T4, F8")
def q_relay_status(spark, d):
    return obx.relay_status(tb.outbox(spark, d), tb.relay_outcomes(spark, d))


@register("relay_dead_count", W("WITH " + _RELAY_SQL + "\nSELECT count(*) FILTER (WHERE dead) AS dead_letters FROM relayed",
                                "v_outbox", "v_relay_outcomes"), "A8")
def q_relay_dead_count(spark, d):
    return obx.outbox_dead_count(obx.relay_status(tb.outbox(spark, d), tb.relay_outcomes(spark, d)))


# --------------------------------------------------------------------------
# Webhooks: U1, P20, F4, F5, F3, J5, F1; usage of all counters A2, A3, A5
# --------------------------------------------------------------------------
from ..operators import webhooks as wh  # noqa: E402

_ISO = ("strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us({c}) // 1000) % 1000 <> 0 THEN '.' || "
        "lpad(CAST((epoch_us({c}) // 1000) % 1000 AS VARCHAR), 3, '0') ELSE '' END || 'Z'")
EVENTS_SQL = COMPLETION_SQL + f""",
ev AS (
  SELECT tenant_id, 'order.placed' AS event_type, order_id AS event_id,
         '{{"event":"order.placed","orderId":"' || order_id || '","customerId":"' || customer_id
         || '","productId":"' || product_id || '","quantity":' || CAST(quantity AS VARCHAR)
         || ',"currency":"' || currency || '","tenantId":"' || tenant_id || '","placedAt":"'
         || {_ISO.format(c='placed_at')} || '"}}' AS payload, placed_at AS event_time
  FROM v_orders
  UNION ALL
  SELECT tenant_id, 'payment.failed', order_id,
         '{{"event":"payment.failed","orderId":"' || order_id || '","paymentId":"'
         || substr(sha256('payment:' || order_id), 1, 32) || '","tenantId":"' || tenant_id
         || '","processedAt":"' || {_ISO.format(c='placed_at')} || '"}}', placed_at
  FROM v_orders WHERE amount > 1000.00
  UNION ALL
  SELECT tenant_id, CASE WHEN status = 'CONFIRMED' THEN 'order.completed' ELSE 'order.rejected' END, order_id,
         '{{"event":"' || CASE WHEN status = 'CONFIRMED' THEN 'order.completed' ELSE 'order.rejected' END
         || '","orderId":"' || order_id || '","status":"' || status || '","tenantId":"' || tenant_id
         || '","completedAt":"' || {_ISO.format(c='completed_at')} || '"}}', completed_at
  FROM comp),
subs AS (
  SELECT DISTINCT endpoint_id, tenant_id, trim(x) AS event_type
  FROM (SELECT id AS endpoint_id, tenant_id, unnest(string_split(event_types, ',')) AS x
        FROM v_endpoints WHERE status = 'ACTIVE')),
fan AS (
  SELECT substr(sha256(s.endpoint_id || ':' || e.event_type || ':' || e.event_id), 1, 32) AS delivery_id,
         s.endpoint_id, e.tenant_id, e.event_type, e.event_id, e.payload, 'PENDING' AS status,
         CAST(0 AS BIGINT) AS attempt_count, e.event_time AS created_at
  FROM ev e JOIN subs s ON s.tenant_id = e.tenant_id AND s.event_type = e.event_type)"""


def _events(spark, d):
    o = tb.orders_stream(spark, d)
    return wh.webhook_events(o, sg.payment_decision(o), sg.saga(o))


def _fanout(spark, d):
    return wh.webhook_fanout(_events(spark, d), tb.endpoints(spark, d))


def _fanout_counts(spark, d):
    return wh.fanout_counts(_events(spark, d), tb.endpoints(spark, d))


@register("webhook_events", W("WITH RECURSIVE " + EVENTS_SQL + """
SELECT tenant_id, event_type, event_id, payload, epoch_us(event_time) AS event_time FROM ev""",
                              "v_orders"), "U1, P20, F4, F5")
def q_webhook_events(spark, d):
    return _events(spark, d)


@register("subscriptions", W("WITH " + """
subs AS (
  SELECT DISTINCT endpoint_id, tenant_id, trim(x) AS event_type
  FROM (SELECT id AS endpoint_id, tenant_id, unnest(string_split(event_types, ',')) AS x
        FROM v_endpoints WHERE status = 'ACTIVE'))
SELECT endpoint_id, tenant_id, event_type FROM subs""", "v_endpoints"), "F3")
def q_subscriptions(spark, d):
    return wh.subscriptions(tb.endpoints(spark, d))


@register("webhook_fanout", W("WITH RECURSIVE " + EVENTS_SQL + """
SELECT delivery_id, endpoint_id, tenant_id, event_type, event_id, payload, status, attempt_count,
       epoch_us(created_at) AS created_at FROM fan""", "v_orders", "v_endpoints"), "J5")
def q_webhook_fanout(spark, d):
    return _fanout(spark, d)


def _pad_sql(kh: str, byte: int) -> str:
    """DuckDB: the 64-byte key (hex text) XOR a repeated pad byte, as a blob."""
    mask = int(f"{byte:02x}" * 4, 16)
    words = [f"printf('%08x', xor(('0x' || substr({kh}, {i * 8 + 1}, 8))::BIGINT, {mask}))" for i in range(16)]
    return "unhex(" + " || ".join(words) + ")"


_KH = ("rpad(hex(CASE WHEN octet_length(encode(e.secret)) > 64 THEN unhex(sha256(encode(e.secret))) "
       "ELSE encode(e.secret) END), 128, '0')")
_HMAC_SQL = (f"'sha256=' || sha256({_pad_sql('kh', 0x5C)} || "
             f"unhex(sha256({_pad_sql('kh', 0x36)} || encode(f.payload))))")


@register("sign_payloads", W("WITH RECURSIVE " + EVENTS_SQL + f""",
keyed AS (SELECT f.*, {_KH} AS kh FROM fan f JOIN v_endpoints e ON e.id = f.endpoint_id)
SELECT delivery_id, endpoint_id, event_type,
       {_HMAC_SQL.replace('encode(f.payload)', 'encode(payload)')} AS signature
FROM keyed""", "v_orders", "v_endpoints"), "F1")
def q_sign_payloads(spark, d):
    return wh.sign_payloads(_fanout(spark, d), tb.endpoints(spark, d))


_ALL_USAGE_SQL = EVENTS_SQL + """,
a AS (SELECT tenant_id, CAST(year(placed_at) AS BIGINT) AS y, CAST(month(placed_at) AS BIGINT) AS m,
             count(*) AS n FROM v_lines WHERE NOT (tenant_id IS NULL OR NOT regexp_matches(tenant_id, '\\S')) GROUP BY ALL),
b AS (SELECT tenant_id, CAST(year(created_at) AS BIGINT) AS y, CAST(month(created_at) AS BIGINT) AS m,
             count(*) AS n FROM fan WHERE NOT (tenant_id IS NULL OR NOT regexp_matches(tenant_id, '\\S')) GROUP BY ALL),
calls AS (SELECT CASE WHEN request_id % 13 = 0 THEN chr(9) ELSE tenant_header END AS tenant_id, ts FROM v_requests),
c AS (SELECT tenant_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m,
             count(*) AS n FROM calls WHERE NOT (tenant_id IS NULL OR NOT regexp_matches(tenant_id, '\\S')) GROUP BY ALL),
keys AS (SELECT tenant_id, y, m FROM a UNION SELECT tenant_id, y, m FROM b UNION SELECT tenant_id, y, m FROM c),
usage_all AS (
  SELECT k.tenant_id, k.y AS billing_year, k.m AS billing_month,
         coalesce(a.n, 0) AS order_count, coalesce(b.n, 0) AS webhook_delivery_count,
         coalesce(c.n, 0) AS api_call_count,
         CASE WHEN upper(coalesce(t.plan, 'FREE')) IN ('FREE','STARTER','PRO','ENTERPRISE')
              THEN upper(coalesce(t.plan, 'FREE')) ELSE 'FREE' END AS plan
  FROM keys k LEFT JOIN a USING (tenant_id, y, m) LEFT JOIN b USING (tenant_id, y, m)
       LEFT JOIN c USING (tenant_id, y, m) LEFT JOIN v_tenants t ON t.id = k.tenant_id)"""


def _usage_all(spark, d):
    # metered by the tenant header, which some calls lack or send blank (a tab on every 13th, ours)
    header = F.when(F.col("request_id") % 13 == 0, F.lit("\t")).otherwise(F.col("tenant_header"))
    req = tb.requests_log(spark, d).select(header.alias("tenant_id"), "ts")
    return met.monthly_usage_all(tb.order_line_counts(spark, d), _fanout_counts(spark, d), req, tb.tenants(spark, d),
                                 weight_col="lines", delivery_weight_col="deliveries")


@register("monthly_usage_all", W("WITH RECURSIVE " + _ALL_USAGE_SQL + f"\nSELECT {_USAGE_COLS} FROM usage_all",
                                 "v_orders", "v_endpoints", "v_lines", "v_requests", "v_tenants"), "A1, A2, A3")
def q_monthly_usage_all(spark, d):
    return _usage_all(spark, d).select(*_USAGE_COLS.split(", "))


_WQ = ("CASE {p} WHEN 'FREE' THEN 0 WHEN 'STARTER' THEN 500 WHEN 'PRO' THEN 10000 ELSE 2147483647 END")


@register("webhook_quota", W("WITH RECURSIVE " + _ALL_USAGE_SQL + f"""
SELECT tenant_id, billing_year, billing_month, plan, webhook_delivery_count,
       CAST({_WQ.format(p='plan')} AS BIGINT) AS webhook_quota,
       webhook_delivery_count >= {_WQ.format(p='plan')} AS exceeded FROM usage_all""",
                             "v_orders", "v_endpoints", "v_lines", "v_requests", "v_tenants"), "A5")
def q_webhook_quota(spark, d):
    return met.webhook_quota_check(_usage_all(spark, d))


# --------------------------------------------------------------------------
# Retries and dead letters: T7, P18
# --------------------------------------------------------------------------
from ..operators import retries as rt  # noqa: E402

# Error classes of the broken requests (ours): what the order listener would raise.
_FAIL_SQL = """
f AS (SELECT order_id AS record_id,
             CASE seq % 50 WHEN 0 THEN 'IllegalArgumentException' WHEN 1 THEN 'TransientException'
                  WHEN 2 THEN 'SerializationException' ELSE 'IllegalStateException' END AS error_class
      FROM v_requests_bad WHERE seq % 50 < 4)"""
_FATAL = "('SerializationException', 'IllegalArgumentException', 'IllegalStateException')"


def _failures(spark, d):
    r = tb.bad_requests(spark, d).filter(F.col("seq") % 50 < 4)
    m = F.col("seq") % 50
    cls = (F.when(m == 0, "IllegalArgumentException").when(m == 1, "TransientException")
            .when(m == 2, "SerializationException").otherwise("IllegalStateException"))
    return r.select(F.col("order_id").alias("record_id"), cls.alias("error_class"))


@register("retry_schedule", W("WITH " + _FAIL_SQL + f"""
SELECT record_id, error_class, CAST(attempt AS BIGINT) AS attempt,
       CAST(CASE WHEN attempt = 1 THEN 0 ELSE least(30000.0, 500 * pow(2.0, attempt - 2)) END AS BIGINT) AS delay_ms,
       'orders.placed' AS topic
FROM f CROSS JOIN range(1, 7) AS r(attempt)
WHERE attempt = 1 OR error_class NOT IN {_FATAL}""", "v_requests_bad"), "T7")
def q_retry_schedule(spark, d):
    return rt.retry_schedule(_failures(spark, d), rt.ORDER_LISTENER, "orders.placed")


@register("dead_letters", W("WITH " + _FAIL_SQL + f"""
SELECT record_id, error_class,
       CAST(CASE WHEN error_class IN {_FATAL} THEN 1 ELSE 6 END AS BIGINT) AS attempts,
       CAST(CASE WHEN error_class IN {_FATAL} THEN 0 ELSE 500 + 1000 + 2000 + 4000 + 8000 END AS BIGINT)
         AS total_delay_ms,
       'orders.placed.DLT' AS dlt_topic
FROM f""", "v_requests_bad"), "T7")
def q_dead_letters(spark, d):
    return rt.dead_letters(_failures(spark, d), rt.ORDER_LISTENER, "orders.placed")


# Every 20th completed order has an id that the notification listener fails on (ours).
_NOTIFIED_SQL = COMPLETION_SQL + """,
notified AS (SELECT CASE WHEN CAST(order_id AS BIGINT) % 20 = 0 THEN 'fail-' || order_id ELSE order_id END AS order_id, status
             FROM comp)"""


def _notified(spark, d):
    oid = F.col("order_id")
    marked = F.when(oid.cast("bigint") % 20 == 0, F.concat(F.lit("fail-"), oid)).otherwise(oid)
    return rt.poison_split(sg.saga(tb.orders_stream(spark, d)).withColumn("order_id", marked))


@register("poison_split", W("WITH RECURSIVE " + _NOTIFIED_SQL + """
SELECT order_id, status, coalesce(starts_with(order_id, 'fail'), false) AS poison FROM notified""", "v_orders"),
          "P18, F14")
def q_poison_split(spark, d):
    return _notified(spark, d).select("order_id", "status", "poison")


@register("notification_retries", W("WITH RECURSIVE " + _NOTIFIED_SQL + """
SELECT order_id AS record_id, 'IllegalStateException' AS error_class, CAST(attempt AS BIGINT) AS attempt,
       CAST(CASE WHEN attempt = 1 THEN 0 ELSE least(30000.0, 1000 * pow(2.0, attempt - 2)) END AS BIGINT) AS delay_ms,
       CASE WHEN attempt = 1 THEN 'orders.completed' ELSE 'orders.completed-retry-' || CAST(attempt - 2 AS VARCHAR) END AS topic
FROM notified CROSS JOIN range(1, 5) AS r(attempt) WHERE starts_with(order_id, 'fail')""", "v_orders"), "T7, P18")
def q_notification_retries(spark, d):
    p = _notified(spark, d).filter("poison")
    fails = p.select(F.col("order_id").alias("record_id"), F.lit("IllegalStateException").alias("error_class"))
    return rt.retry_schedule(fails, rt.NOTIFICATION, "orders.completed")


# --------------------------------------------------------------------------
# Metrics: A9, A10, A11, F11
# --------------------------------------------------------------------------
from ..operators import metrics as mx  # noqa: E402


@register("orders_per_minute", W("""
WITH w AS (
  SELECT time_bucket(INTERVAL 30 SECOND, placed_at) AS s FROM v_orders
  UNION ALL
  SELECT time_bucket(INTERVAL 30 SECOND, placed_at) - INTERVAL 30 SECOND FROM v_orders)
SELECT epoch_us(s) AS window_start, epoch_us(s + INTERVAL 1 MINUTE) AS window_end, count(*) AS orders
FROM w GROUP BY s""", "v_orders"), "A9")
def q_orders_per_minute(spark, d):
    return mx.orders_per_minute(tb.orders_stream(spark, d))


def _hist_sql() -> str:
    b = tb.LATENCY_BUCKETS
    res = f"{b[-1]!r}"
    for i in reversed(range(len(b))):
        lo = "0.0" if i == 0 else repr(b[i - 1])
        c_lo = "0" if i == 0 else f"c{i - 1}"
        val = f"({lo} + ({b[i]!r} - {lo}) * (0.99 * total - {c_lo}) / ({'c' + str(i)} - {c_lo}))"
        res = f"CASE WHEN c{i} >= 0.99 * total THEN {val} ELSE {res} END"
    cnts = ", ".join(f"count(*) FILTER (WHERE seconds <= {le!r}) AS c{i}" for i, le in enumerate(b))
    return (f"WITH h AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, count(*) AS total, {cnts} "
            f"FROM v_latency GROUP BY 1)\nSELECT epoch_us(s) AS window_start, total, round({res}, 9) AS p99_seconds FROM h")


@register("latency_p99_hist", W(_hist_sql(), "v_latency"), "A10")
def q_latency_p99_hist(spark, d):
    return mx.latency_p99_hist(tb.latency(spark, d), tb.LATENCY_BUCKETS)


@register("latency_p99", W("""
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, count(*) AS total,
       round(quantile_cont(seconds, 0.99), 9) AS p99_seconds FROM v_latency GROUP BY 1""", "v_latency"), "A10")
def q_latency_p99(spark, d):
    return mx.latency_p99(tb.latency(spark, d))


@register("failure_rate", W("""
SELECT request_id, tenant_id, calls, failures, failures / calls AS failure_rate,
       calls = 20 AND failures / calls >= 0.5 AS flagged
FROM (SELECT request_id, tenant_id,
             count(*) OVER w AS calls,
             sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failures
      FROM v_requests
      WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, request_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
                          "v_requests"), "A11, W2")
def q_failure_rate(spark, d):
    r = tb.requests_log(spark, d).withColumn("failed", F.col("event_type") == "error")
    f = mx.failure_rate(r, "tenant_id", ["ts", "request_id"])
    return f.select("request_id", "tenant_id", "calls", "failures", "failure_rate", "flagged")


@register("log_trace_ids", W("""
SELECT conv_id, turn, nullif(regexp_extract(line, '"traceId":"(\\w+)"', 1), '') AS trace_id FROM v_logs""",
                             "v_logs"), "F11")
def q_log_trace_ids(spark, d):
    return mx.log_trace_ids(tb.logs(spark, d)).select("conv_id", "turn", "trace_id")


# --------------------------------------------------------------------------
# Sources: S3 record decoding with defaults, S8 sample orders
# --------------------------------------------------------------------------
from ..sources import topics as tp  # noqa: E402


@register("decode_events", W("""
SELECT order_id, customer_id, product_id, CAST(quantity AS BIGINT) AS quantity, CAST(amount AS DOUBLE) AS amount,
       'USD' AS currency, (epoch_us(placed_at) // 1000) * 1000 AS placed_at, correlation_id,
       CASE WHEN seq % 6 = 0 THEN '' ELSE tenant_id END AS tenant_id
FROM v_orders""", "v_orders"), "S3")
def q_decode_events(spark, d):
    o = tb.orders_stream(spark, d, keep_seq=True)
    recs = tp.encode_order_records(o, omit_currency=(F.col("seq") % 4 == 0),
                                   omit_tenant=(F.col("seq") % 6 == 0))
    return tp.decode_events(recs)


@register("sample_orders", W("""
SELECT 'load-' || CAST(event_id AS VARCHAR) AS order_id,
       'cust-' || CAST((event_id * 7 + 3) % 10 AS VARCHAR) AS customer_id,
       'prod-' || CAST((event_id * 13 + 5) % 5 AS VARCHAR) AS product_id,
       CAST((event_id * 31 + 7) % 5 + 1 AS BIGINT) AS quantity,
       CAST((event_id * 97 + 11) % 1500 + 10 AS DOUBLE) AS amount, 'USD' AS currency
FROM events"""), "S8")
def q_sample_orders(spark, d):
    return tp.sample_orders(tb.read_table(spark, d, "events"))


# --------------------------------------------------------------------------
# Remaining finders and ids: P14, T5 (endpoints), F10
# --------------------------------------------------------------------------
@register("tenant_deliveries", W("WITH RECURSIVE " + EVENTS_SQL + f"""
SELECT delivery_id, endpoint_id, event_type, event_id, epoch_us(created_at) AS created_at
FROM fan WHERE tenant_id = '{TENANT}'""", "v_orders", "v_endpoints"), "P14, L3")
def q_tenant_deliveries(spark, d):
    f = _fanout(spark, d).filter(F.col("tenant_id") == TENANT)
    return f.orderBy(F.col("created_at").desc(), "delivery_id").select(
        "delivery_id", "endpoint_id", "event_type", "event_id", "created_at")


@register("endpoint_status", W(f"""
WITH cmd AS (
  SELECT CAST(s_suppkey * 3 % {N_ADDRESSED} AS VARCHAR) AS id, 'disable' AS command, s_suppkey AS seq
  FROM supplier WHERE s_suppkey % 4 = 1),
latest AS (SELECT id, arg_max(command, seq) AS cmd FROM cmd GROUP BY id)
SELECT coalesce(e.id, l.id) AS id, CASE WHEN e.status IS NULL THEN 'not_found'
       WHEN l.cmd = 'disable' THEN 'DISABLED' ELSE e.status END AS status
FROM v_endpoints e FULL JOIN latest l ON e.id = l.id""", "v_endpoints"), "T5")
def q_endpoint_status(spark, d):
    s = tb.read_table(spark, d, "supplier").filter(F.col("s_suppkey") % 4 == 1)
    cmds = s.select((F.col("s_suppkey") * 3 % tb.addressed_endpoints(spark, d)).cast("string").alias("id"),
                    F.lit("disable").alias("command"), F.lit(None).cast("string").alias("arg"),
                    F.col("s_suppkey").alias("seq"))
    e = tb.endpoints(spark, d).select("id", F.lit(None).cast("string").alias("name"), "status")
    return ten.apply_status_commands(e, cmds).select("id", "status")


@register("api_keys", W("""
SELECT id, slug, substr(sha256('api-key:' || id), 1, 32) AS api_key FROM v_tenants""", "v_tenants"), "F10")
def q_api_keys(spark, d):
    from ..functions.ids import api_key
    t = tb.tenants(spark, d)
    return t.select("id", "slug", api_key(F.col("id")).alias("api_key"))


# --------------------------------------------------------------------------
# P3 for the seven stored tables: a row for each rule that a row breaks
# --------------------------------------------------------------------------
from ..operators import constraints as cons  # noqa: E402
from ..sources.broken_rows import SELECTS, broken_rows  # noqa: E402


def _rules_sql(table: str, nulls: str, lengths: dict[str, int], enums: dict[str, str], keys: dict[str, str],
               other: dict[str, str] | None = None) -> str:
    """The oracle of a table: a select for each rule over the same derived rows."""
    preds = {f"{c}_null": f"{c} IS NULL" for c in nulls.split()}
    preds |= {f"{c}_too_long": f"length({c}) > {n}" for c, n in lengths.items()}
    preds |= {f"{c}_not_allowed": f"{c} NOT IN ({vals})" for c, vals in enums.items()}
    for name, cols in keys.items():
        preds[f"{name}_repeated"] = f"({cols}) IN (SELECT ({cols}) FROM b WHERE ({cols}) IS NOT NULL GROUP BY {cols} HAVING count(*) > 1)"
        if "," in cols:   # a row of several columns is not null when one of them is
            whole = " AND ".join(f"{c.strip()} IS NOT NULL" for c in cols.split(","))
            preds[f"{name}_repeated"] = f"{whole} AND count(*) OVER (PARTITION BY {cols}) > 1"
    preds |= other or {}
    parts = "\nUNION ALL ".join(f"(SELECT id, '{rule}' AS rule FROM b QUALIFY {p})" if " OVER " in p
                                else f"SELECT id, '{rule}' AS rule FROM b WHERE {p}" for rule, p in preds.items())
    return f"WITH b AS (SELECT {', '.join(SELECTS[table])} FROM events)\n{parts}"


_PLAN_LIST = "'FREE','STARTER','PRO','ENTERPRISE'"
_MONTH_NULLS = ("id tenant_id plan billing_year billing_month order_count webhook_delivery_count api_call_count "
                "created_at updated_at")
_MONTH_KEY = {"id": "id", "tenant_month": "tenant_id, billing_year, billing_month"}
_RULES_SQL = {
    "orders": _rules_sql("orders", "id tenant_id customer_id product_id quantity amount currency status created_at",
                         {"tenant_id": 64, "customer_id": 64, "product_id": 64, "currency": 3, "status": 16},
                         {"status": "'PLACED','CONFIRMED','REJECTED'"}, {"id": "id"},
                         {"quantity_not_positive": "quantity <= 0", "amount_not_positive": "amount <= 0"}),
    "outbox": _rules_sql("outbox", "id tenant_id aggregate_type aggregate_id topic event_type payload created_at retry_count",
                         {"tenant_id": 64, "aggregate_type": 64, "aggregate_id": 64, "topic": 128, "event_type": 64,
                          "last_error": 512}, {}, {"id": "id"}),
    "usage_records": _rules_sql("usage_records", _MONTH_NULLS, {"tenant_id": 64, "plan": 16}, {"plan": _PLAN_LIST}, _MONTH_KEY),
    "invoices": _rules_sql("invoices", _MONTH_NULLS + " amount_cents status", {"tenant_id": 64, "plan": 16, "status": 16},
                           {"plan": _PLAN_LIST, "status": "'DRAFT','FINALIZED','PAID','VOID'"}, _MONTH_KEY),
    "tenants": _rules_sql("tenants", "id slug name plan status api_key created_at updated_at",
                          {"slug": 63, "name": 255, "plan": 16, "status": 16, "api_key": 64},
                          {"plan": _PLAN_LIST, "status": "'ACTIVE','SUSPENDED','DELETED'"},
                          {"id": "id", "slug": "slug", "api_key": "api_key"}),
    "webhook_endpoints": _rules_sql("webhook_endpoints", "id tenant_id url secret event_types status created_at updated_at", {},
                                    {"status": "'ACTIVE','DISABLED'"}, {"id": "id"}),
    "webhook_deliveries": _rules_sql(
        "webhook_deliveries", "id endpoint_id tenant_id event_type event_id payload status attempt_count created_at updated_at", {},
        {"status": "'PENDING','DELIVERED','FAILED','EXHAUSTED'"}, {"id": "id"},
        {"endpoint_id_unknown": "endpoint_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"}),
}


def _rules_query(table: str):
    def q(spark, d):
        parents = {"endpoint_id": tb.endpoints(spark, d)} if table == "webhook_deliveries" else None
        return cons.violations(broken_rows(spark, d, table), cons.TABLES[table], parents)
    return q


for _table, _sql in _RULES_SQL.items():
    register(f"rules_{_table}", _sql, "P3")(_rules_query(_table))
