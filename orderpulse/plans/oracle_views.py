"""DuckDB text of the adapter views, for the oracle queries.

Written from the adapter definitions (FIXTURES.md section B), independently of
the Spark code in ``orderpulse.sources.tables``.  ``with_views(sql, ...)``
prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

_PLAN = ("CASE {k} % 5 WHEN 0 THEN 'FREE' WHEN 1 THEN 'STARTER' WHEN 2 THEN 'PRO' "
         "WHEN 3 THEN 'ENTERPRISE' ELSE 'LEGACY' END")

# Tenants of the order stream and the endpoints, and the endpoint ids that deliveries address.
N_TENANTS = "(SELECT greatest(25, count(*) // 4) FROM supplier)"
N_ADDRESSED = "(SELECT count(*) * 6 // 5 FROM supplier)"

VIEWS: dict[str, str] = {
    "v_orders": f"""
  SELECT CAST(event_id AS VARCHAR) AS order_id, CAST(user_id AS VARCHAR) AS customer_id,
         json_extract_string(props, '$.k') AS product_id,
         CAST(event_id % 5 + 1 AS INTEGER) AS quantity,
         CAST("value" * 10 AS DECIMAL(12,2)) AS amount, 'USD' AS currency,
         CAST(ts AS TIMESTAMP) AS placed_at, 'c' || CAST(event_id AS VARCHAR) AS correlation_id,
         CAST(user_id % {N_TENANTS} AS VARCHAR) AS tenant_id, event_id AS seq
  FROM events""",
    "v_requests_bad": """
  SELECT order_id, customer_id,
         CASE WHEN seq % 50 = 0 THEN '' ELSE product_id END AS product_id,
         CASE WHEN seq % 50 = 1 THEN 0 ELSE quantity END AS quantity,
         CASE WHEN seq % 50 = 2 THEN CAST(0 AS DECIMAL(12,2)) ELSE amount END AS amount,
         currency, placed_at, correlation_id,
         CASE WHEN seq % 50 = 3 THEN NULL ELSE tenant_id END AS tenant_id, seq
  FROM v_orders""",
    "v_lines": """
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
         CAST(n.n_regionkey AS VARCHAR) AS tenant_id, CAST(o.o_orderdate AS TIMESTAMP) AS placed_at,
         l.l_quantity AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_tenants": f"""
  SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(n_name) AS slug, n_name AS name,
         {_PLAN.format(k='n_nationkey')} AS plan,
         CASE WHEN n_nationkey % 7 = 6 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
         'key-' || CAST(n_nationkey AS VARCHAR) AS api_key
  FROM nation""",
    "v_requests": f"""
  SELECT event_id AS request_id, CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         CAST(floor((epoch_us(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 20000000) AS BIGINT) AS req_ms,
         CAST(ts AS TIMESTAMP) AS ts, {_PLAN.format(k='user_id')} AS plan,
         'key-' || CAST(user_id % 30 AS VARCHAR) AS api_key,
         CASE WHEN event_id % 10 = 0 THEN '/actuator/health' ELSE '/api/orders' END AS path,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id % 5 AS VARCHAR) END AS tenant_header,
         CASE WHEN event_id % 11 = 0 THEN 'internal-secret' ELSE NULL END AS internal_token,
         event_type
  FROM events""",
    "v_endpoints": f"""
  SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey % {N_TENANTS} AS VARCHAR) AS tenant_id,
         'https://h/' || CAST(s_suppkey AS VARCHAR) AS url,
         'secret-key-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS secret,
         CASE s_suppkey % 4 WHEN 0 THEN 'order.placed' WHEN 1 THEN 'order.placed, order.completed'
              WHEN 2 THEN 'payment.failed,order.rejected' ELSE 'order.completed,order.completed' END
           AS event_types,
         CASE WHEN s_suppkey % 10 = 9 THEN 'DISABLED' ELSE 'ACTIVE' END AS status
  FROM supplier""",
    "v_attempts": """
  SELECT event_id % (SELECT count(*) // 5 FROM events) AS delivery_id, event_id AS attempt_id,
         CAST(ts AS TIMESTAMP) AS ts,
         CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN 200 ELSE 500 END
           AS http_status,
         CASE WHEN event_type = 'click' THEN 'timeout' ELSE NULL END AS error
  FROM events""",
    "v_outbox": """
  SELECT 'ob-' || order_id AS id, 'Order' AS aggregate_type, order_id AS aggregate_id,
         'orders.placed' AS topic, 'OrderPlaced' AS event_type,
         CASE WHEN seq % 97 = 0 THEN to_base64(encode(substr(js, 1, 10))) ELSE to_base64(encode(js)) END
           AS payload,
         placed_at AS created_at,
         CASE WHEN seq % 3 = 0 THEN NULL ELSE placed_at + INTERVAL 1 SECOND END AS processed_at,
         CAST(seq % 7 AS INTEGER) AS retry_count, tenant_id, seq
  FROM (SELECT *, '{"orderId":"' || order_id || '","customerId":"' || customer_id
               || '","productId":"' || product_id || '","quantity":' || CAST(quantity AS VARCHAR)
               || ',"amount":"' || CAST(amount AS VARCHAR) || '","currency":"' || currency
               || '","placedAt":' || CAST(epoch_us(placed_at) // 1000 AS VARCHAR) || ',"correlationId":"' || correlation_id
               || '","tenantId":"' || tenant_id || '"}' AS js FROM v_orders)""",
    "v_relay_outcomes": """
  SELECT 'ob-' || CAST(event_id % (SELECT count(*) // 6 FROM events) AS VARCHAR) AS event_id, event_id AS outcome_id,
         CAST(ts AS TIMESTAMP) AS "at", event_type = 'purchase' AS ok,
         CASE event_type WHEN 'click' THEN 'broker timeout'
              WHEN 'error' THEN 'leader not available: ' || repeat('x', 600) END AS error
  FROM events""",
    "v_latency": """
  SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, "value" / 100 AS seconds FROM events""",
    "v_logs": """
  SELECT conv_id, turn,
         CASE WHEN (conv_id + turn) % 2 = 0
              THEN '{"traceId":"t' || CAST(conv_id AS VARCHAR) || 'x' || CAST(turn AS VARCHAR) || '"} ' || text
              ELSE text END AS line
  FROM conversations""",
    "v_endpoint_requests": """
  SELECT id, tenant_id,
         CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'not-a-url' ELSE url END AS url,
         CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN 'short' ELSE secret END AS secret,
         CASE WHEN CAST(id AS BIGINT) % 19 = 0 THEN '' ELSE event_types END AS event_types
  FROM v_endpoints""",
    "v_lookups": """
  SELECT event_id AS lookup_id,
         CASE WHEN event_id % 10 = 0 THEN 'missing-' || CAST(event_id AS VARCHAR)
              ELSE CAST(event_id AS VARCHAR) END AS order_id,
         CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(user_id AS VARCHAR)
              ELSE CAST(user_id + 1 AS VARCHAR) END AS caller
  FROM events""",
    "v_catalog": """
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_retailprice AS price FROM part""",
}

# Views a view depends on (they must come first in the WITH list).
DEPENDS = {"v_requests_bad": ["v_orders"], "v_outbox": ["v_orders"],
           "v_endpoint_requests": ["v_endpoints"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    body = sql.strip()
    if not order:
        return body
    tail = None
    for prefix in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(prefix):
            recursive = recursive or prefix == "WITH RECURSIVE "
            tail = body[len(prefix):]
            break
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if tail is not None:
        return head + ctes + ",\n" + tail
    return head + ctes + "\n" + body
