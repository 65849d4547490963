"""Topics as fixed-schema tables: read (S1), write keyed (S2), decode records
with field defaults (S3) and the load recipe as a job over a driving table (S8).

A topic is a Parquet directory with one of the event schemas below.  With the
Kafka connector on the classpath the same functions read and write Kafka
(``kafka_bootstrap=...``); it is not bundled here, so Parquet is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed_topic import keyed_scan, keyed_write

# Topic names.
ORDERS_PLACED = "orders.placed"
PAYMENTS_PROCESSED = "payments.processed"
INVENTORY_RESERVED = "inventory.reserved"
ORDERS_COMPLETED = "orders.completed"

ORDER_PLACED = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("product_id", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("amount", T.DecimalType(12, 2)), T.StructField("currency", T.StringType()),
    T.StructField("placed_at", T.TimestampType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
])
PAYMENT_PROCESSED = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("payment_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("processed_at", T.TimestampType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
])
INVENTORY_RESERVED_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("product_id", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("reserved_at", T.TimestampType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
])
ORDER_COMPLETED = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("completed_at", T.TimestampType()),
    T.StructField("correlation_id", T.StringType()), T.StructField("tenant_id", T.StringType()),
])
SCHEMAS = {ORDERS_PLACED: ORDER_PLACED, PAYMENTS_PROCESSED: PAYMENT_PROCESSED,
           INVENTORY_RESERVED: INVENTORY_RESERVED_SCHEMA, ORDERS_COMPLETED: ORDER_COMPLETED}

# The record (wire) form of an order event: camelCase JSON with millisecond times.
ORDER_RECORD = T.StructType([
    T.StructField("orderId", T.StringType()), T.StructField("customerId", T.StringType()),
    T.StructField("productId", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("amount", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("placedAt", T.LongType()), T.StructField("correlationId", T.StringType()),
    T.StructField("tenantId", T.StringType()),
])
# Avro field defaults of the order event.
DEFAULT_CURRENCY = "USD"
DEFAULT_TENANT = ""


def topic_scan(spark: SparkSession, root: str, topic: str, stream: bool = False,
               max_files_per_trigger: int | None = None,
               kafka_bootstrap: str | None = None, keyed: bool = False) -> DataFrame:
    """Read a topic from the earliest record.

    ``keyed`` reads a topic with partitions and offsets (``keyed_topic``), whose positions are two more columns.

    Parquet topics hold only committed files (the file sink commits through
    its log), which matches ``read_committed``.  ``stream=True`` gives a
    streaming DataFrame; ``max_files_per_trigger`` bounds a micro-batch.
    """
    schema = SCHEMAS[topic]
    if kafka_bootstrap:
        reader = spark.readStream if stream else spark.read
        raw = (reader.format("kafka").option("kafka.bootstrap.servers", kafka_bootstrap)
               .option("subscribe", topic).option("startingOffsets", "earliest")
               .option("kafka.isolation.level", "read_committed").load())
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    path = f"{root.rstrip('/')}/{topic}"
    if keyed:
        return keyed_scan(spark, path, schema, stream)
    if stream:
        r = spark.readStream.schema(schema)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_topic(df: DataFrame, root: str, topic: str, key_col: str, partitions: int = 6,
                checkpoint: str | None = None, trigger_available_now: bool = True, keyed: bool = False):
    """Append records to a keyed topic; ``keyed`` gives them partitions and offsets (``keyed_topic``).

    Records are hash-partitioned by key into ``partitions`` files per write,
    as a keyed producer spreads them over topic partitions.  A stream needs a
    checkpoint: the file sink then commits each micro-batch exactly once.
    """
    path = f"{root.rstrip('/')}/{topic}"
    cols = [f.name for f in SCHEMAS[topic].fields]
    out = df.select(*cols)
    if keyed:
        return keyed_write(out, path, F.col(key_col), partitions, checkpoint=checkpoint)
    if df.isStreaming:
        w = (out.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append"))
        w = w.trigger(availableNow=True) if trigger_available_now else w
        return w.start()
    out.repartition(partitions, key_col).write.mode("append").parquet(path)
    return None


def order_record(currency: Column | None = None, tenant: Column | None = None) -> Column:
    """The JSON record of an order row; null fields are left out of the text."""
    return F.to_json(F.struct(
        F.col("order_id").alias("orderId"), F.col("customer_id").alias("customerId"), F.col("product_id").alias("productId"),
        F.col("quantity").alias("quantity"), F.col("amount").cast("string").alias("amount"),
        (F.col("currency") if currency is None else currency).alias("currency"), F.unix_millis("placed_at").alias("placedAt"),
        F.col("correlation_id").alias("correlationId"), (F.col("tenant_id") if tenant is None else tenant).alias("tenantId")))


def encode_order_records(orders: DataFrame, omit_currency: Column | None = None,
                         omit_tenant: Column | None = None) -> DataFrame:
    """Order events as keyed JSON records, some without the fields that have defaults."""
    cur = None if omit_currency is None else F.when(~omit_currency, F.col("currency"))
    ten = None if omit_tenant is None else F.when(~omit_tenant, F.col("tenant_id"))
    return orders.select(F.col("order_id").alias("key"), order_record(cur, ten).alias("value"))


def event_fields(record: str) -> list[Column]:
    """The columns of an order event from a parsed record column, defaults filled in (currency, tenant)."""
    r = lambda name: F.col(f"{record}.{name}")
    return [r("orderId").alias("order_id"), r("customerId").alias("customer_id"), r("productId").alias("product_id"),
            r("quantity").alias("quantity"), r("amount").cast("decimal(12,2)").alias("amount"),
            F.coalesce(r("currency"), F.lit(DEFAULT_CURRENCY)).alias("currency"), F.timestamp_millis(r("placedAt")).alias("placed_at"),
            r("correlationId").alias("correlation_id"), F.coalesce(r("tenantId"), F.lit(DEFAULT_TENANT)).alias("tenant_id")]


def decode_events(records: DataFrame, value_col: str = "value") -> DataFrame:
    """S3: parse order records and fill the field defaults (currency, tenant)."""
    return records.select(F.from_json(F.col(value_col), ORDER_RECORD).alias("r")).select(*event_fields("r"))


def sample_orders(driver: DataFrame, seq_col: str = "event_id") -> DataFrame:
    """The load recipe as a job - one sample order per driving row.

    10 customers, 5 products, quantity 1-5, whole amounts 10-1509; values come
    from fixed arithmetic on the row's sequence number, so reruns agree.
    """
    s = F.col(seq_col)
    return driver.select(
        F.concat(F.lit("load-"), s.cast("string")).alias("order_id"),
        F.concat(F.lit("cust-"), F.pmod(s * 7 + 3, F.lit(10)).cast("string")).alias("customer_id"),
        F.concat(F.lit("prod-"), F.pmod(s * 13 + 5, F.lit(5)).cast("string")).alias("product_id"),
        (F.pmod(s * 31 + 7, F.lit(5)) + 1).cast("int").alias("quantity"),
        (F.pmod(s * 97 + 11, F.lit(1500)) + 10).cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"))
