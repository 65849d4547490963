"""The transactional outbox: payload decoding (S6), the relay schedule (S7,
L1), the relay state machine (T4), the dead-letter scan (T8) and the pending
and dead counts (A7, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ERROR_MAX_CHARS, cut, from_base64
from ..sources.topics import ORDER_RECORD, event_fields
from .ranking import global_row_number

# Fixed values of the relay.
BATCH_SIZE = 100
MAX_RETRIES = 5
DEAD_PAGE = 10
DECODE_ERROR = "undecodable payload"
# Fields of the order record without a default.
NO_DEFAULT = ("orderId", "customerId", "productId", "quantity", "amount", "placedAt", "correlationId")


def decoded_order_id(payload: Column) -> Column:
    """The order id of an outbox payload, null when it does not decode."""
    return F.get_json_object(from_base64(payload), "$.orderId")


def decode_outbox(outbox: DataFrame) -> DataFrame:
    """base64 -> JSON text -> order id; broken payloads become failures.

    Invalid base64 decodes to null (``try_to_binary``) and malformed JSON reads
    as null, so one bad row never stops the job.
    """
    order_id = decoded_order_id(F.col("payload"))
    ok = order_id.isNotNull()
    return outbox.select("id", "topic", ok.alias("ok"), order_id.alias("order_id"),
                         F.when(~ok, F.lit(DECODE_ERROR)).alias("error"))


def outbox_events(outbox: DataFrame) -> DataFrame:
    """The whole order event of each outbox row, typed, with the fields' defaults (currency, tenant).

    A payload that is no record, or one without a field that has no default, gives ``ok`` false, an
    error and null event columns.
    """
    parsed = outbox.select("id", "topic", F.from_json(from_base64(F.col("payload")), ORDER_RECORD).alias("_record"))
    fields = event_fields("_record")
    ok = F.col("_record").isNotNull()
    for name in NO_DEFAULT:
        ok = ok & F.col(f"_record.{name}").isNotNull()
    x = parsed.select("id", "topic", F.coalesce(ok, F.lit(False)).alias("ok"), F.struct(*fields).alias("_event"))
    names = x.schema["_event"].dataType.names
    return x.select("id", "topic", "ok", *[F.when(F.col("ok"), F.col(f"_event.{n}")).alias(n) for n in names],
                    F.when(~F.col("ok"), F.lit(DECODE_ERROR)).alias("error"))


def unprocessed(outbox: DataFrame) -> DataFrame:
    return outbox.filter(F.col("processed_at").isNull())


def outbox_pending(outbox: DataFrame) -> DataFrame:
    """The pending gauge, one row."""
    return outbox.agg(F.count(F.when(F.col("processed_at").isNull(), 1)).alias("pending"))


def outbox_batch(outbox: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """L1: the oldest ``size`` unprocessed rows (a top-k, not a full sort)."""
    return unprocessed(outbox).orderBy("created_at", "id").limit(size)


def outbox_relay(outbox: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Every unprocessed row with the relay cycle that publishes it.

    Cycle ``k`` takes rows ``k*batch .. (k+1)*batch-1`` in (created_at, id)
    order; the global position comes from :func:`global_row_number`, so no
    single task sorts the whole backlog.  Rows go to the topic named in their
    ``topic`` column (a writer partitions the output by it).
    """
    r = global_row_number(unprocessed(outbox), ["created_at", "id"], "position")
    return r.select("id", "topic", "aggregate_id", "position",
                    F.floor((F.col("position") - 1) / batch_size).cast("bigint").alias("cycle"))


def outbox_dead_scan(outbox: DataFrame, page: int = DEAD_PAGE) -> DataFrame:
    """retry_count >= 5 and still unprocessed, one page (Q3: after T4 this is empty)."""
    d = outbox.filter((F.col("retry_count") >= MAX_RETRIES) & F.col("processed_at").isNull())
    return d.orderBy("created_at", "id").limit(page)


def relay_status(outbox: DataFrame, outcomes: DataFrame) -> DataFrame:
    """T4: every outbox row after the given relay ``outcomes`` (event_id, outcome_id, at, ok, error).

    An outcome counts while its row is unprocessed.  A success processes the row; a failure adds a retry and keeps
    the error, cut to 500 characters (F8); at 5 retries the row is processed and dead.  A payload that does
    not decode (S6) fails whatever the broker says.

    Not more than ``MAX_RETRIES`` outcomes of a row can count, as each one processes it or adds a retry, so the first
    ones by (at, outcome_id) are taken by rank, which is cut in the task before the shuffle, and folded as an array
    in the JVM.  No key is ever collected beyond that.
    """
    first = Window.partitionBy("event_id").orderBy("at", "outcome_id")
    few = outcomes.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= MAX_RETRIES)
    step = F.struct("_k", "at", "ok", "error")
    runs = few.groupBy("event_id").agg(F.array_sort(F.collect_list(step)).alias("_run"))
    rows = outbox.withColumn("_decodes", decoded_order_id(F.col("payload")).isNotNull())
    rows = rows.join(runs, rows["id"] == runs["event_id"], "left")

    start = F.struct(F.col("processed_at").isNotNull().alias("processed"), F.col("retry_count").cast("int").alias("retry_count"),
                     F.lit(None).cast("string").alias("last_error"), F.lit(False).alias("dead"),
                     F.col("processed_at").alias("processed_at"), F.lit(0).alias("used"))

    def fold(st: Column, x: Column) -> Column:
        good = F.coalesce(x["ok"], F.lit(False)) & F.col("_decodes")
        error = F.when(F.col("_decodes"), cut(x["error"])).otherwise(F.lit(DECODE_ERROR))
        retry = st["retry_count"] + F.when(good, 0).otherwise(1)
        dead = ~good & (retry >= MAX_RETRIES)
        then = F.struct((good | dead).alias("processed"), retry.cast("int").alias("retry_count"),
                        F.when(good, st["last_error"]).otherwise(error).alias("last_error"), dead.alias("dead"),
                        F.when(good | dead, x["at"]).alias("processed_at"), (st["used"] + 1).alias("used"))
        return F.when(st["processed"], st).otherwise(then)

    none = F.array().cast("array<struct<_k:int,at:timestamp,ok:boolean,error:string>>")
    return rows.select("id", F.aggregate(F.coalesce("_run", none), start, fold).alias("s")).select("id", "s.*")


def outbox_status(outbox: DataFrame) -> DataFrame:
    """T4: every outbox row after the relay has ended with it, a narrow projection.

    Rows already processed are unchanged.  A payload that decodes (S6) is processed in its first cycle;
    any other fails each cycle, one second apart, until it has 5 retries, and is then processed and
    dead, its error cut to 500 characters.  ``relay_status`` takes given outcomes instead.
    """
    done = F.col("processed_at").isNotNull()
    failed = ~done & decoded_order_id(F.col("payload")).isNull()
    failures = F.when(failed, F.greatest(F.lit(1), F.lit(MAX_RETRIES) - F.col("retry_count"))).otherwise(F.lit(0))
    return outbox.select(
        "id", F.lit(True).alias("processed"),
        (F.col("retry_count") + failures).cast("int").alias("retry_count"),
        F.when(failed, F.substring(F.lit(DECODE_ERROR), 1, ERROR_MAX_CHARS)).alias("last_error"),
        failed.alias("dead"),
        F.when(done, F.col("processed_at"))
         .otherwise(F.col("created_at") + F.make_interval(secs=F.greatest(F.lit(1), failures))).alias("processed_at"))


def outbox_dead_count(status: DataFrame) -> DataFrame:
    """How many events the relay gave up on."""
    return status.agg(F.count(F.when(F.col("dead"), 1)).alias("dead_letters"))
