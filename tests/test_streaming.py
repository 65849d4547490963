"""Stream = batch: the saga, the interval join and metering over time-ordered
files, one file per micro-batch, including a restart from the checkpoint."""
import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from orderpulse.operators import saga as sg
from orderpulse.operators import metering as met
from orderpulse.sources import tables as tb
from orderpulse.sources import topics as tp
from orderpulse.streaming import jobs, saga as ss
from conftest import SF01

EXPECTED = {("CONFIRMED", None): 2975, ("REJECTED", "out_of_stock"): 5709, ("REJECTED", "payment_declined"): 1316}


def _write_chunks(pdf, schema, path, parts, start=0):
    os.makedirs(path, exist_ok=True)
    for i, chunk in enumerate(np.array_split(pdf, parts)):
        t = pa.Table.from_pandas(chunk.reset_index(drop=True), preserve_index=False)
        pq.write_table(t.cast(schema), f"{path}/part-{start + i:03d}.parquet")
        time.sleep(0.02)  # distinct modification times keep the file order


def _orders_pdf(spark):
    o = tb.orders_stream(spark, SF01)
    return o.toPandas().sort_values(["placed_at", "order_id"]).reset_index(drop=True)


def _arrow_schema():
    return pa.schema([("order_id", pa.string()), ("customer_id", pa.string()), ("product_id", pa.string()),
                      ("quantity", pa.int32()), ("amount", pa.decimal128(12, 2)), ("currency", pa.string()),
                      ("placed_at", pa.timestamp("us", tz="UTC")), ("correlation_id", pa.string()),
                      ("tenant_id", pa.string())])


def _summary(rows):
    out = {}
    for r in rows:
        out[(r.status, r.reason)] = out.get((r.status, r.reason), 0) + 1
    return out


def _run_saga(spark, src, sink, ckpt):
    s = tp.topic_scan(spark, src.rsplit("/", 1)[0], tp.ORDERS_PLACED, stream=True, max_files_per_trigger=1)
    q = (ss.saga_stream(s).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(600)


def test_saga_stream_equals_batch_with_restart(spark, tmp_path):
    pdf = _orders_pdf(spark)
    root = str(tmp_path / "topics")
    src = f"{root}/{tp.ORDERS_PLACED}"
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    first, rest = pdf.iloc[:6000], pdf.iloc[6000:]
    _write_chunks(first, _arrow_schema(), src, 3)
    _run_saga(spark, src, sink, ckpt)
    _write_chunks(rest, _arrow_schema(), src, 2, start=3)   # later files, same checkpoint
    _run_saga(spark, src, sink, ckpt)
    got = spark.read.parquet(sink).collect()
    assert len(got) == 10000
    assert _summary(got) == EXPECTED


def test_interval_join_stream_equals_batch(spark, tmp_path):
    o = tb.orders_stream(spark, SF01)
    root = str(tmp_path / "topics")
    pay = sg.payment_decision(o)
    res = sg.reservations(o)
    for name, df, order_col in ((tp.PAYMENTS_PROCESSED, pay, "processed_at"), (tp.INVENTORY_RESERVED, res, "reserved_at")):
        cols = [f.name for f in tp.SCHEMAS[name].fields]
        t = df.select(*cols)
        # four files in event-time order
        ts_all = sorted(r[0] for r in t.select(order_col).collect())
        cuts = [ts_all[int(len(ts_all) * k / 4)] for k in range(1, 4)]
        edges = [None] + cuts + [None]
        for lo, hi in zip(edges[:-1], edges[1:]):
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (F.col(order_col) >= F.lit(lo))
            if hi is not None:
                cond = cond & (F.col(order_col) < F.lit(hi))
            t.filter(cond).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
            time.sleep(0.02)
    p = tp.topic_scan(spark, root, tp.PAYMENTS_PROCESSED, stream=True, max_files_per_trigger=1)
    r = tp.topic_scan(spark, root, tp.INVENTORY_RESERVED, stream=True, max_files_per_trigger=1)
    sink = str(tmp_path / "out")
    q = (ss.completion_stream(p, r).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.read.parquet(sink).collect()
    assert len(got) == 10000 and _summary(got) == EXPECTED


def test_metering_deltas_are_idempotent(spark, tmp_path):
    pdf = _orders_pdf(spark)
    root = str(tmp_path / "topics")
    _write_chunks(pdf, _arrow_schema(), f"{root}/{tp.ORDERS_PLACED}", 3)
    s = tp.topic_scan(spark, root, tp.ORDERS_PLACED, stream=True, max_files_per_trigger=1)
    deltas, ckpt = str(tmp_path / "deltas"), str(tmp_path / "ckpt")
    jobs.metering_stream(s, deltas, ckpt).awaitTermination(600)
    jobs.metering_stream(s, deltas, ckpt).awaitTermination(600)   # nothing new: no double counting
    got = {(r.tenant_id, r.billing_year, r.billing_month): r.order_count
           for r in jobs.usage_from_deltas(spark, deltas).collect()}
    want = {(r.tenant_id, r.billing_year, r.billing_month): r.order_count
            for r in met.monthly_counts(tb.orders_stream(spark, SF01), "placed_at", "order_count").collect()}
    assert got == want


def test_orders_per_minute_stream_matches_batch_for_closed_windows(spark, tmp_path):
    pdf = _orders_pdf(spark)
    root = str(tmp_path / "topics")
    _write_chunks(pdf, _arrow_schema(), f"{root}/{tp.ORDERS_PLACED}", 3)
    s = tp.topic_scan(spark, root, tp.ORDERS_PLACED, stream=True, max_files_per_trigger=1)
    sink = str(tmp_path / "out")
    q = (jobs.orders_per_minute_stream(s).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    from orderpulse.operators.metrics import orders_per_minute
    batch = {r.window_start: r.orders for r in orders_per_minute(tb.orders_stream(spark, SF01)).collect()}
    got = {r.window_start: r.orders for r in spark.read.parquet(sink).collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    # every window that closed before the final watermark was emitted
    assert len(got) >= len(batch) - 4


def test_metering_dedup_drops_redelivered_orders(spark, tmp_path):
    pdf = _orders_pdf(spark).iloc[:2000]
    root = str(tmp_path / "topics")
    # the same orders delivered twice (at-least-once upstream)
    _write_chunks(pdf, _arrow_schema(), f"{root}/{tp.ORDERS_PLACED}", 1)
    _write_chunks(pdf, _arrow_schema(), f"{root}/{tp.ORDERS_PLACED}", 1, start=1)
    s = tp.topic_scan(spark, root, tp.ORDERS_PLACED, stream=True, max_files_per_trigger=1)
    deltas = str(tmp_path / "deltas")
    jobs.metering_stream(s, deltas, str(tmp_path / "ckpt"), dedup=True, delay="365 days").awaitTermination(600)
    total = jobs.usage_from_deltas(spark, deltas).agg(F.sum("order_count")).first()[0]
    assert total == 2000


def _write_df_in_time_order(df, order_col, path, parts=4):
    ts_all = sorted(r[0] for r in df.select(order_col).collect())
    cuts = [ts_all[int(len(ts_all) * k / parts)] for k in range(1, parts)]
    edges = [None] + cuts + [None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(order_col) >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(order_col) < F.lit(hi))
        df.filter(cond).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def test_rate_limit_and_delivery_streams_equal_batch(spark, tmp_path):
    from orderpulse.operators.delivery import delivery_status
    from orderpulse.operators.ratelimit import rate_limit_decisions
    from orderpulse.streaming.stateful import delivery_stream, rate_limit_stream
    req = tb.requests_log(spark, SF01)
    _write_df_in_time_order(req, "ts", str(tmp_path / "req"))
    s = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "req"))
    q = (rate_limit_stream(s).writeStream.format("parquet").option("path", str(tmp_path / "rl"))
         .option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "rl")).collect()}
    want = {r.request_id: r.allowed for r in rate_limit_decisions(req).collect()}
    assert got == want

    att = tb.attempts(spark, SF01)
    _write_df_in_time_order(att, "ts", str(tmp_path / "att"))
    s2 = spark.readStream.schema(att.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "att"))
    q2 = (delivery_stream(s2).writeStream.format("parquet").option("path", str(tmp_path / "dl"))
          .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(600)
    states = spark.read.parquet(str(tmp_path / "dl"))
    final = states.groupBy("delivery_id").agg(F.max_by("status", F.struct("ts", "attempt_id")).alias("s"))
    got2 = {r.delivery_id: r.s for r in final.collect()}
    want2 = {r.delivery_id: r.status for r in delivery_status(att).collect()}
    assert got2 == want2


def test_topic_write_relay_and_feed_streams(spark, tmp_path):
    from orderpulse.operators.webhooks import placed_events, webhook_fanout
    o = tb.orders_stream(spark, SF01)
    root = str(tmp_path / "topics")
    tp.write_topic(o, root, tp.ORDERS_PLACED, "order_id", partitions=6)            # S2 batch
    back = tp.topic_scan(spark, root, tp.ORDERS_PLACED)                              # S1 batch
    assert back.count() == 10000 and len(back.inputFiles()) == 6
    s = tp.topic_scan(spark, root, tp.ORDERS_PLACED, stream=True)
    q = tp.write_topic(s, str(tmp_path / "copy"), tp.ORDERS_PLACED, "order_id",    # S2 stream
                       checkpoint=str(tmp_path / "ck0"))
    q.awaitTermination(600)
    assert tp.topic_scan(spark, str(tmp_path / "copy"), tp.ORDERS_PLACED).count() == 10000
    # J3 stream-static and J5 stream-static on the same functions as batch
    eps = tb.endpoints(spark, SF01)
    fan = webhook_fanout(placed_events(s), eps)
    q3 = (fan.writeStream.format("parquet").option("path", str(tmp_path / "fan"))
          .option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start())
    q3.awaitTermination(600)
    assert spark.read.parquet(str(tmp_path / "fan")).count() == webhook_fanout(placed_events(o), eps).count()
    feed = sg.customer_feed(ss.saga_stream(s), o)
    q4 = (feed.writeStream.format("parquet").partitionBy("customer_id").option("path", str(tmp_path / "feed"))
          .option("checkpointLocation", str(tmp_path / "ck4")).trigger(availableNow=True).start())
    q4.awaitTermination(600)
    assert spark.read.parquet(str(tmp_path / "feed")).count() == 10000
    # S7 relay stream: unprocessed outbox rows land under their topic
    ob = tb.outbox(spark, SF01)
    ob.write.parquet(str(tmp_path / "outbox"))
    obs = spark.readStream.schema(ob.schema).parquet(str(tmp_path / "outbox"))
    jobs.relay_stream(obs, str(tmp_path / "published"), str(tmp_path / "ck5"), failed_root=str(tmp_path / "failed")).awaitTermination(600)
    pub = spark.read.parquet(str(tmp_path / "published"))
    # every 97th payload is broken: it is a failed attempt and is not published
    assert pub.count() == ob.filter("processed_at IS NULL AND seq % 97 != 0").count()
    assert spark.read.parquet(str(tmp_path / "failed")).count() == ob.filter("processed_at IS NULL AND seq % 97 = 0").count() > 0
    assert {r.topic for r in pub.select("topic").distinct().collect()} == {"orders.placed"}


def test_placement_status_and_routing_sinks(spark, tmp_path):
    req = tb.bad_requests(spark, SF01).drop("seq")
    req.write.parquet(str(tmp_path / "req"))
    rs = spark.readStream.schema(req.schema).parquet(str(tmp_path / "req"))
    jobs.place_orders_stream(rs, str(tmp_path / "placed"), str(tmp_path / "ck1")).awaitTermination(600)
    n_orders = jobs.placed(spark, str(tmp_path / "placed"), "orders").count()
    n_outbox = jobs.placed(spark, str(tmp_path / "placed"), "outbox").count()
    assert n_orders == n_outbox == 9200          # 4 of every 50 requests are invalid

    pdf = _orders_pdf(spark)
    root = str(tmp_path / "topics")
    _write_chunks(pdf, _arrow_schema(), f"{root}/{tp.ORDERS_PLACED}", 2)
    s = tp.topic_scan(spark, root, tp.ORDERS_PLACED, stream=True, max_files_per_trigger=1)
    jobs.order_status_stream(ss.saga_stream(s), str(tmp_path / "st"), str(tmp_path / "ck2")).awaitTermination(600)
    o = tb.orders_stream(spark, SF01)
    got = {r.order_id: r.status for r in jobs.order_status_from_deltas(spark, o, str(tmp_path / "st")).collect()}
    want = {r.order_id: r.status for r in sg.order_status(o, sg.saga(o)).collect()}
    assert got == want

    outcomes = spark.createDataFrame([(1, "ok"), (2, "retry"), (3, "dead"), (4, "ok")], "id long, outcome string")
    jobs.route_outcomes(outcomes, str(tmp_path / "routed"), 0)
    assert spark.read.parquet(str(tmp_path / "routed/ok")).count() == 2
    assert spark.read.parquet(str(tmp_path / "routed/dead")).count() == 1


def test_interval_join_drops_a_late_file(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal
    root = str(tmp_path / "topics")
    t0 = dt.datetime(2024, 1, 1)

    def orders(ids, minute):
        rows = [(f"o{i}", "c", "p", 1, Decimal("1.00"), "USD", t0 + dt.timedelta(minutes=minute), f"c{i}", "t")
                for i in ids]
        return spark.createDataFrame(rows, tp.ORDER_PLACED)

    def write(df, topic, schema):
        df.select(*[f.name for f in schema.fields]).coalesce(1).write.mode("append").parquet(f"{root}/{topic}")
        time.sleep(0.05)

    early, late, later = orders(range(0, 5), 0), orders(range(10, 15), 1), orders(range(5, 10), 60)
    # file 1: both facts of o0-o4, and the reservations of o10-o14
    write(sg.payment_decision(early), tp.PAYMENTS_PROCESSED, tp.PAYMENT_PROCESSED)
    write(sg.reservations(early).unionByName(sg.reservations(late)), tp.INVENTORY_RESERVED,
          tp.INVENTORY_RESERVED_SCHEMA)
    # file 2: an hour later, both facts of o5-o9 (moves the watermark to 00:55)
    write(sg.payment_decision(later), tp.PAYMENTS_PROCESSED, tp.PAYMENT_PROCESSED)
    write(sg.reservations(later), tp.INVENTORY_RESERVED, tp.INVENTORY_RESERVED_SCHEMA)
    # file 3: on time (00:61); this batch runs under the 00:55 watermark and evicts old state
    ontime = orders(range(15, 20), 61)
    write(sg.payment_decision(ontime), tp.PAYMENTS_PROCESSED, tp.PAYMENT_PROCESSED)
    write(sg.reservations(ontime), tp.INVENTORY_RESERVED, tp.INVENTORY_RESERVED_SCHEMA)
    # file 4: the payments of o10-o14 arrive late; their reservations are gone
    write(sg.payment_decision(late), tp.PAYMENTS_PROCESSED, tp.PAYMENT_PROCESSED)
    p = tp.topic_scan(spark, root, tp.PAYMENTS_PROCESSED, stream=True, max_files_per_trigger=1)
    r = tp.topic_scan(spark, root, tp.INVENTORY_RESERVED, stream=True, max_files_per_trigger=1)
    sink = str(tmp_path / "out")
    q = (ss.completion_stream(p, r).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = sorted(int(x.order_id[1:]) for x in spark.read.parquet(sink).collect())
    assert got == list(range(10)) + list(range(15, 20))   # late payments complete nothing (no grace)
