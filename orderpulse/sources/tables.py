"""Table scans (S4) and the adapter views over the driver's test tables.

Each adapter turns one of the given TPC-H-like tables into the shape of a
reference entity (an order stream, a tenant registry, webhook endpoints, ...).
Every view is a plain projection over ``spark.read.parquet`` so Catalyst
prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_base64
from .topics import order_record

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Plan names by key modulo 5, as the adapter spec defines them
# (LEGACY is an unknown plan on purpose).
PLAN_BY_MOD5 = ("FREE", "STARTER", "PRO", "ENTERPRISE", "LEGACY")
# Endpoint subscription lists by key modulo 4.
EVENT_TYPES_BY_MOD4 = ("order.placed", "order.placed, order.completed",
                       "payment.failed,order.rejected", "order.completed,order.completed")
# 2024-01-01T00:00:00Z in epoch microseconds; one request millisecond per 20 s of event time.
REQ_EPOCH_US = 1704067200000000
REQ_US_PER_MS = 20000000
INTERNAL_TOKEN = "internal-secret"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by_mod(key: Column, values: tuple[str, ...]) -> Column:
    expr = F.lit(None).cast("string")
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)).otherwise(expr) if i else F.when(key == i, F.lit(v))
    return expr


def _plan_of(key: Column) -> Column:
    return _by_mod(F.pmod(key, F.lit(5)), PLAN_BY_MOD5)


def tenant_count(spark: SparkSession, sf_dir: str) -> Column:
    """Tenants of the order stream and the endpoints: one for four endpoints, 25 at least, so a tenant's
    endpoints stay few and the fan-out grows with the events."""
    n = F.count(F.lit(1))
    return read_table(spark, sf_dir, "supplier").select(F.greatest(F.lit(25), F.floor(n / 4))).scalar()


def orders_stream(spark: SparkSession, sf_dir: str, *, keep_seq: bool = False) -> DataFrame:
    """``v_orders``: the order stream of the saga, one order per event."""
    ev = read_table(spark, sf_dir, "events")
    cols = [
        F.col("event_id").cast("string").alias("order_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        (F.col("event_id") % 5 + 1).cast("int").alias("quantity"),
        (F.col("value") * 10).cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("ts").cast("timestamp").alias("placed_at"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("correlation_id"),
        (F.col("user_id") % tenant_count(spark, sf_dir)).cast("string").alias("tenant_id"),
    ]
    if keep_seq:
        cols.append(F.col("event_id").alias("seq"))
    return ev.select(*cols)


def bad_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_requests_bad``: order requests with one broken field every 50 rows."""
    o = orders_stream(spark, sf_dir, keep_seq=True)
    m = F.col("seq") % 50
    return o.select(
        "order_id", "customer_id",
        F.when(m == 0, F.lit("")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(m == 1, F.lit(0)).otherwise(F.col("quantity")).alias("quantity"),
        F.when(m == 2, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("amount")).alias("amount"),
        "currency", "placed_at", "correlation_id",
        F.when(m == 3, F.lit(None).cast("string")).otherwise(F.col("tenant_id")).alias("tenant_id"),
        "seq",
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_lines``: one metered order per line item, tenant = region of the customer."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                      "l_linenumber", "l_quantity")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # customer and nation are dimension tables: the planner broadcasts them by its
    # own size estimate (autoBroadcastJoinThreshold), lineitem x orders is a shuffle join.
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, od.o_custkey == cu.c_custkey)
           .join(na, cu.c_nationkey == na.n_nationkey))
    return j.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("n_regionkey").cast("string").alias("tenant_id"),
        F.col("o_orderdate").cast("timestamp").alias("placed_at"),
        F.col("l_quantity").alias("quantity"),
    )


def order_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_lines`` pre-aggregated for metering: one row per order with its line count.

    Counting lines per order key first is a partial aggregate on the largest
    table; its output is already hash-partitioned on the key the join to
    ``orders`` needs, so the join shuffles one row per order instead of one
    per line.  Summing ``lines`` gives the same counts as counting ``v_lines``.
    """
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("lines")))
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, od.o_custkey == cu.c_custkey)
           .join(na, cu.c_nationkey == na.n_nationkey))
    return j.select(F.col("n_regionkey").cast("string").alias("tenant_id"),
                    F.col("o_orderdate").cast("timestamp").alias("placed_at"), "lines")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_tenants``: the tenant registry, one tenant per nation."""
    na = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return na.select(
        k.cast("string").alias("id"),
        F.lower("n_name").alias("slug"),
        F.col("n_name").alias("name"),
        _plan_of(k).alias("plan"),
        F.when(k % 7 == 6, F.lit("SUSPENDED")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.concat(F.lit("key-"), k.cast("string")).alias("api_key"),
    )


def requests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_requests``: API requests in arrival order (``req_ms``, then ``ts``)."""
    ev = read_table(spark, sf_dir, "events")
    t = F.col("user_id") % 5
    return ev.select(
        F.col("event_id").alias("request_id"),
        t.cast("string").alias("tenant_id"),
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(REQ_EPOCH_US))
                / F.lit(REQ_US_PER_MS)).cast("bigint").alias("req_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
        _plan_of(t).alias("plan"),
        F.concat(F.lit("key-"), (F.col("user_id") % 30).cast("string")).alias("api_key"),
        # request-gate fields (ours): every 10th call is a health probe, every 7th
        # lacks the tenant header, every 11th carries the internal token.
        F.when(F.col("event_id") % 10 == 0, F.lit("/actuator/health"))
         .otherwise(F.lit("/api/orders")).alias("path"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(t.cast("string")).alias("tenant_header"),
        F.when(F.col("event_id") % 11 == 0, F.lit(INTERNAL_TOKEN))
         .otherwise(F.lit(None).cast("string")).alias("internal_token"),
        "event_type",
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_endpoints``: webhook endpoints, one per supplier."""
    su = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sid = k.cast("string")
    return su.select(
        sid.alias("id"),
        (k % tenant_count(spark, sf_dir)).cast("string").alias("tenant_id"),
        F.concat(F.lit("https://h/"), sid).alias("url"),
        F.concat(F.lit("secret-key-"), F.lpad(sid, 8, "0")).alias("secret"),
        _by_mod(k % 4, EVENT_TYPES_BY_MOD4).alias("event_types"),
        F.when(k % 10 == 9, F.lit("DISABLED")).otherwise(F.lit("ACTIVE")).alias("status"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_attempts``: delivery attempt outcomes, five events per delivery."""
    ev = read_table(spark, sf_dir, "events")
    n_deliveries = ev.select((F.count(F.lit(1)) / 5).cast("bigint")).scalar()
    et = F.col("event_type")
    return ev.select(
        (F.col("event_id") % n_deliveries).cast("bigint").alias("delivery_id"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(et == "click", F.lit(None).cast("int"))
         .when(et == "view", F.lit(200)).otherwise(F.lit(500)).alias("http_status"),
        F.when(et == "click", F.lit("timeout")).otherwise(F.lit(None).cast("string")).alias("error"),
    )


def addressed_endpoints(spark: SparkSession, sf_dir: str) -> Column:
    """Endpoint ids that deliveries and commands address: a fifth more than there are endpoints."""
    n = F.count(F.lit(1))
    return read_table(spark, sf_dir, "supplier").select(F.floor(n * 6 / 5)).scalar()


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_outbox``: outbox rows of the order stream; every 97th payload is broken."""
    o = orders_stream(spark, sf_dir, keep_seq=True)
    js = order_record()
    payload = F.when(o.seq % 97 == 0, to_base64(F.substring(js, 1, 10))).otherwise(to_base64(js))
    return o.select(
        F.concat(F.lit("ob-"), o.order_id).alias("id"),
        F.lit("Order").alias("aggregate_type"),
        o.order_id.alias("aggregate_id"),
        F.lit("orders.placed").alias("topic"),
        F.lit("OrderPlaced").alias("event_type"),
        payload.alias("payload"),
        o.placed_at.alias("created_at"),
        F.when(o.seq % 3 == 0, F.lit(None).cast("timestamp"))
         .otherwise(o.placed_at + F.expr("INTERVAL 1 SECOND")).alias("processed_at"),
        (o.seq % 7).cast("int").alias("retry_count"),
        o.tenant_id,
        o.seq,
    )


def relay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_relay_outcomes`` (ours): what the broker said to attempts on outbox rows, six events a row."""
    ev = read_table(spark, sf_dir, "events")
    rows = ev.select(F.floor(F.count(F.lit(1)) / 6).cast("bigint")).scalar()
    et = F.col("event_type")
    return ev.select(
        F.concat(F.lit("ob-"), (F.col("event_id") % rows).cast("string")).alias("event_id"),
        F.col("event_id").alias("outcome_id"),
        F.col("ts").cast("timestamp").alias("at"),
        (et == "purchase").alias("ok"),
        F.when(et == "click", F.lit("broker timeout"))
         .when(et == "error", F.concat(F.lit("leader not available: "), F.repeat(F.lit("x"), 600))).alias("error"),
    )


# The default latency histogram bucket bounds (seconds).
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_latency``: one request latency in seconds per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("request_id"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     (F.col("value") / 100).alias("seconds"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_logs``: conversation turns as log lines, every second one with a trace id."""
    cv = read_table(spark, sf_dir, "conversations")
    tid = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("x"),
                   F.col("turn").cast("string"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0,
                  F.concat(F.lit('{"traceId":"'), tid, F.lit('"} '), F.col("text"))) \
            .otherwise(F.col("text"))
    return cv.select("conv_id", "turn", line.alias("line"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_catalog``: product prices."""
    pa = read_table(spark, sf_dir, "part")
    return pa.select(F.col("p_partkey").cast("string").alias("product_id"),
                     F.col("p_retailprice").alias("price"))


def endpoint_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint registration requests (ours): ``v_endpoints`` with a bad URL every
    13th, a short secret every 17th and no event types every 19th supplier."""
    e = endpoints(spark, sf_dir)
    k = F.col("id").cast("bigint")
    return e.select(
        "id", "tenant_id",
        F.when(k % 13 == 0, F.lit("not-a-url")).otherwise(F.col("url")).alias("url"),
        F.when(k % 17 == 0, F.lit("short")).otherwise(F.col("secret")).alias("secret"),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.col("event_types")).alias("event_types"),
    )


def order_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lookups (ours): every 10th asks for an unknown id; the caller is
    absent, the owner, or another customer by ``event_id % 3``."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("lookup_id"),
        F.when(eid % 10 == 0, F.concat(F.lit("missing-"), eid.cast("string")))
         .otherwise(eid.cast("string")).alias("order_id"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .when(eid % 3 == 1, F.col("user_id").cast("string"))
         .otherwise((F.col("user_id") + 1).cast("string")).alias("caller"),
    )
