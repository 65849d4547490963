"""Commits, compaction, resumed folds and retries on streams, each against its batch form."""
import datetime as dt

import pytest
from orderpulse.operators import delivery, metering, ratelimit, reserve, retries
from orderpulse.operators.metering import MONTH_KEY
from orderpulse.sources import tables as tb
from orderpulse.streaming import committed, jobs, keyed, retrying
from pyspark.sql import functions as F

from conftest import SF001

T0 = dt.datetime(2024, 1, 1)


def files(df, path, order, parts):
    """``df`` in ``parts`` files along ``order``; gives the cumulative row counts."""
    rows = df.orderBy(*order).collect()
    for k in range(parts):
        part = rows[len(rows) * k // parts:len(rows) * (k + 1) // parts]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    a, b = (x.select(sorted(x.columns)) for x in (a, b))
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_reader_between_two_writes_sees_neither(spark, tmp_path):
    t = committed.CommittedTables(spark, str(tmp_path / "t"))
    assert t.read("orders") is None
    one, two = spark.range(3), spark.range(5)
    assert t.commit(0, {"orders": one, "outbox": one})
    t.write(1, {"orders": two})                       # the second table is not written, no commit
    assert t.read("orders").count() == 3 and t.read("outbox").count() == 3
    assert t.commit(1, {"orders": two, "outbox": two})  # the replay
    assert not t.commit(1, {"orders": two.limit(1), "outbox": two.limit(1)})
    assert t.read("orders").count() == 8 and t.read("outbox").count() == 8 and t.read("orders", before=1).count() == 3


def test_compacted_usage_equals_uncompacted(spark, tmp_path):
    orders, src, root = tb.orders_stream(spark, SF001), str(tmp_path / "src"), str(tmp_path / "usage")
    files(orders, src, ["placed_at", "order_id"], 3)
    jobs.metering_stream(stream(spark, orders, src), root, str(tmp_path / "ck")).awaitTermination(600)
    want = metering.monthly_counts(orders, "placed_at", "order_count").select(*MONTH_KEY, "order_count")
    same(jobs.usage_from_deltas(spark, root), want)
    t = committed.CommittedTables(spark, root)
    assert jobs.compact_usage(spark, root) == 2 and len(t.superseded("usage")) == 3
    same(jobs.usage_from_deltas(spark, root), want)
    assert jobs.compact_usage(spark, root) is None    # one folder is left
    assert t.commit(3, {"usage": want.limit(1)})
    assert t.read("usage").count() == want.count() + 1
    assert jobs.compact_usage(spark, root) == 3 and t.read("usage").count() == want.count()


def run(spark, tmp_path, df, job, order, parts=3, **how):
    """The folded rows of a stream over files, stopped and started again before the last file."""
    src, root, ck = (str(tmp_path / x) for x in ("src", "root", "ck"))
    rows = df.orderBy(*order).collect()
    cut = len(rows) * (parts - 1) // parts
    files(spark.createDataFrame(rows[:cut], df.schema), src, order, parts - 1)
    keyed.keyed_stream(stream(spark, df, src), job, root, ck, **how).awaitTermination(600)
    spark.createDataFrame(rows[cut:], df.schema).coalesce(1).write.mode("append").parquet(src)
    keyed.keyed_stream(stream(spark, df, src), job, root, ck, **how).awaitTermination(600)
    return committed.CommittedTables(spark, root)


def test_stock_stream_with_a_hot_product(spark, tmp_path):
    """Half of the orders are for one product; its slices are in several tasks and the stock goes on over batches."""
    orders = tb.orders_stream(spark, SF001)
    hot = F.when(F.crc32(F.col("order_id").cast("binary")) % 2 == 0, "hot").otherwise(F.col("product_id"))
    orders = spark.createDataFrame(orders.withColumn("product_id", hot).collect(), orders.schema)
    job = keyed.stock_job(40)
    t = run(spark, tmp_path, orders, job, ("placed_at", "order_id"), num_partitions=6, compact_every=2)
    same(t.read("rows").drop(committed.BATCH), reserve.stock_reservation(orders, 40))
    assert t.superseded("state")
    folded = keyed.fold_batch(orders, keyed.states_before(t, job), job, 6)
    tasks = folded.where("product_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """The tenant's open window goes on over the end of a micro-batch."""
    base = keyed.limited_requests(tb.requests_log(spark, SF001))
    base = spark.createDataFrame(base.collect(), base.schema)
    t = run(spark, tmp_path, base, keyed.rate_job(), ("req_ms", "ts", "request_id"), num_partitions=5)
    want = ratelimit.rate_limit_decisions(base).where("rate_limit is not null").drop("allowed", "remaining")
    same(t.read("rows").drop(committed.BATCH), want)


def test_delivery_stream_equals_batch(spark, tmp_path):
    base = tb.attempts(spark, SF001)
    base = spark.createDataFrame(base.collect(), base.schema)
    t = run(spark, tmp_path, base, keyed.delivery_job(), ("ts", "attempt_id"), num_partitions=4)
    got = t.read("rows").drop(committed.BATCH)
    got = (got.withColumn("next_attempt_at", F.timestamp_micros("next_attempt_us"))
           .withColumn("delivered_at", F.timestamp_micros("delivered_us")).drop("next_attempt_us", "delivered_us"))
    same(got, delivery.attempt_states(base))
    final = keyed.states_before(t, keyed.delivery_job()).select("delivery_id", "status", "attempt_count")
    same(final, delivery.delivery_status(base).select("delivery_id", "status", "attempt_count"))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """The commit is there but the stream's checkpoint is lost: the batches come again."""
    base = tb.attempts(spark, SF001).limit(300)
    base = spark.createDataFrame(base.collect(), base.schema)
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    files(base, src, ["ts", "attempt_id"], 2)
    for k in range(2):
        keyed.keyed_stream(stream(spark, base, src), keyed.delivery_job(), root, str(tmp_path / f"ck{k}")).awaitTermination(600)
    assert committed.CommittedTables(spark, root).read("rows").count() == 300


@pytest.mark.parametrize("policy", [retries.NOTIFICATION, retries.ORDER_LISTENER])
def test_retry_stream_equals_batch_after_a_restart(spark, tmp_path, policy):
    schema = "record_id string, error_class string, fails int, at timestamp"
    errors = ["IOException", "IllegalStateException", "SerializationException", None]
    rows = [(f"r{k:03d}", errors[k % 4], None if k % 3 else k % 6, T0 + dt.timedelta(milliseconds=700 * k)) for k in range(60)]
    src, root, ck = (str(tmp_path / x) for x in ("src", "root", "ck"))
    clock = [("clock", None, None, T0 + dt.timedelta(hours=1))]
    for part in (rows[:25], rows[25:50]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def go():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        retrying.retry_topics(retrying.retry_stream(s, policy, "orders", fails_col="fails"), root, ck).awaitTermination(600)

    go()
    t = committed.CommittedTables(spark, root)
    early = t.read("attempts").count()
    for part in (rows[50:], clock):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    go()
    got, dead = t.read("attempts").where("record_id != 'clock'"), t.read("dead")
    assert early < got.count()
    failing = spark.createDataFrame([r for r in rows if r[1] is not None], schema)
    want = retries.retry_schedule(failing, policy, "orders", fails_col="fails")
    same(got.where("error_class is not null").select("record_id", "error_class", "attempt", "delay_ms", "topic"),
         want.withColumn("attempt", F.col("attempt").cast("int")))
    letters = retries.dead_letters(failing, policy, "orders", fails_col="fails")
    same(dead.select("record_id", "error_class", F.col("attempt").alias("attempts"), F.col("waited_ms").alias("total_delay_ms"), F.col("topic").alias("dlt_topic")),
         letters.withColumn("attempts", F.col("attempts").cast("int")))
    assert got.where("error_class is null").count() == sum(r[1] is None for r in rows)
    recovered = {r[0] for r in rows if r[1] and r[2] is not None and r[2] < (1 if r[1] in policy.fatal else policy.attempts)}
    assert {r.record_id for r in got.where("outcome = 'ok' and error_class is not null").collect()} == recovered


def late_facts(spark, count, seed):
    """Facts of ``count`` orders a minute apart, reservations up to 14 minutes late and some repeated."""
    import random

    from orderpulse.operators import saga as sg
    rnd = random.Random(seed)
    rows = []
    for k in range(count):
        at = T0 + dt.timedelta(minutes=k)
        rows.append((f"o{k:03d}", sg.PAYMENT_FACT, at, at, "APPROVED" if k % 4 else "DECLINED", f"c{k}", "t"))
        for _ in range(1 + (k % 9 == 0)):
            arrives = at + dt.timedelta(minutes=rnd.randrange(15), seconds=rnd.randrange(60))
            rows.append((f"o{k:03d}", sg.RESERVED_FACT, at + dt.timedelta(minutes=rnd.randrange(-6, 7)), arrives, "RESERVED", f"c{k}", "t"))
    schema = "order_id string, side string, at timestamp, arrived_at timestamp, status string, correlation_id string, tenant_id string"
    return spark.createDataFrame(rows, schema)


def plain_completions(rows):
    """What completes, fact by fact as they arrive."""
    window, now, seen, out = dt.timedelta(minutes=5), None, [], []
    for r in sorted(rows, key=lambda r: (r.arrived_at, r.side, r.order_id)):
        now = r.at if now is None else max(now, r.at)
        if r.at < now - window:
            continue
        out += [(r.order_id, max(r.at, o.at)) for o in seen if o.order_id == r.order_id and o.side != r.side and abs(o.at - r.at) <= window]
        seen.append(r)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_late_facts_complete_nothing_in_any_split(spark, tmp_path, parts):
    from orderpulse.operators import saga as sg
    from orderpulse.streaming import no_grace
    facts = late_facts(spark, 60, 4)
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    files(facts, src, sg.FACT_ORDER, parts)
    no_grace.completion_no_grace_stream(stream(spark, facts, src), root, str(tmp_path / "ck"), num_partitions=3).awaitTermination(600)
    got = committed.CommittedTables(spark, root).read("completions")
    want = plain_completions(facts.collect())
    assert sorted((r.order_id, r.completed_at) for r in got.collect()) == want
    assert 0 < len({w[0] for w in want}) < 60
    batch = sg.complete_facts(sg.on_time(facts, num_partitions=4))
    assert sorted((r.order_id, r.completed_at) for r in batch.collect()) == want


def plain_relay(row, outcomes):
    """The relay's loop over one row."""
    processed, retry, error, dead, at, used = row.processed_at is not None, row.retry_count, None, False, row.processed_at, 0
    for o in sorted(outcomes, key=lambda o: (o.at, o.outcome_id)):
        if processed:
            break
        used += 1
        if o.ok and row.good:
            processed, at = True, o.at
            continue
        retry += 1
        error = (o.error[:500] if o.error is not None else None) if row.good else "undecodable payload"
        if retry >= 5:
            processed, dead, at = True, True, o.at
    return (row.id, processed, retry, error, dead, at, used)


def test_relay_over_given_outcomes(spark):
    """Long errors, errors without text, the fifth retry, outcomes after the end, a hot row and rows without outcomes."""
    from orderpulse.functions.text import to_base64
    from orderpulse.operators import outbox as obx
    good, bad = '{"orderId":"1"}', "{broken"
    rows = [(f"e{k}", good if k % 4 else bad, k % 7, None if k % 5 else T0) for k in range(40)]
    outbox = spark.createDataFrame(rows, "id string, body string, retry_count int, processed_at timestamp").withColumn("payload", to_base64(F.col("body")))
    outcomes = [(f"e{k % 30}", k, T0 + dt.timedelta(seconds=(k * 37) % 200), k % 6 == 5, ["x" * 700, None, "short"][k % 3]) for k in range(150)]
    outcomes += [("e31", 1000 + k, T0 + dt.timedelta(seconds=k // 2), False, "e" * (498 + k % 5)) for k in range(400)]
    out = spark.createDataFrame(outcomes, "event_id string, outcome_id long, at timestamp, ok boolean, error string").repartition(4)
    got = obx.relay_status(outbox, out)
    by_id = {}
    for o in out.collect():
        by_id.setdefault(o.event_id, []).append(o)
    want = [plain_relay(r, by_id.get(r.id, [])) for r in outbox.withColumn("good", F.col("body") == good).collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.agg(F.max(F.length("last_error"))).first()[0] == 500
    assert obx.outbox_dead_count(got).first().dead_letters == sum(w[4] for w in want) > 0
