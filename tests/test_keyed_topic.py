"""Keyed topics: fixed partitions, offsets without gaps, commits, restart of a stream from its offsets."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from orderpulse.sources import keyed_topic as kt
from orderpulse.sources import tables as tb
from orderpulse.sources import topics as tp

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, lo, hi):
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 != 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(lo, hi, 1, 5).select(k.alias("k"), F.col("id").alias("n"))


def check_offsets(df):
    g = df.groupBy(kt.PARTITION).agg(F.count("*").alias("c"), F.countDistinct(kt.OFFSET).alias("d"), F.min(kt.OFFSET).alias("lo"), F.max(kt.OFFSET).alias("hi"))
    for r in g.collect():
        assert r.lo == 0 and r.c == r.d == r.hi + 1


def test_writes_give_offsets_without_gaps_and_fixed_partitions(spark, tmp_path):
    path = str(tmp_path / "topic")
    assert kt.keyed_scan(spark, path, SCHEMA).count() == 0
    for lo in (0, 500, 1000):
        kt.keyed_write(rows(spark, lo, lo + 500), path, F.col("k"), 4)
    kt.keyed_write(rows(spark, 0, 0), path, F.col("k"), 4)
    got = kt.keyed_scan(spark, path, SCHEMA)
    assert sorted(r.n for r in got.collect()) == list(range(1500))
    assert got.groupBy("k").agg(F.countDistinct(kt.PARTITION).alias("p")).where("p > 1").count() == 0
    check_offsets(got)
    hot = got.where("k = 'hot'").withColumn("write", F.floor(F.col("n") / 500))
    b = {r.write: (r.lo, r.hi) for r in hot.groupBy("write").agg(F.min(kt.OFFSET).alias("lo"), F.max(kt.OFFSET).alias("hi")).collect()}
    assert b[0][1] < b[1][0] and b[1][1] < b[2][0]


def test_ordered_write_keeps_the_order_of_a_hot_key_over_tasks(spark, tmp_path):
    path = str(tmp_path / "topic")
    name = "spark.sql.adaptive.coalescePartitions.enabled"   # else these few rows would be one task's
    spark.conf.set(name, "false")
    try:
        kt.keyed_write(rows(spark, 0, 20000).orderBy(F.xxhash64("n")), path, F.col("k"), 3, order=["n"])
    finally:
        spark.conf.unset(name)
    got = kt.keyed_scan(spark, path, SCHEMA)
    check_offsets(got)
    by = [(r[kt.PARTITION], r.n) for r in got.orderBy(kt.PARTITION, kt.OFFSET).collect()]
    assert by == sorted(by)
    hot = spark.range(1).select(kt.partition_of(F.lit("hot"), 3).alias("p")).first().p
    assert len([p for p in kt._Log(path).files({}, kt._Log(path).ends()) if p.partition == hot]) > 1


def test_stream_goes_on_from_its_offsets(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))

    def run():
        s = kt.keyed_scan(spark, src, SCHEMA, stream=True).drop(kt.PARTITION, kt.OFFSET)
        kt.keyed_write(s, dst, F.col("k"), 3, checkpoint=ck).awaitTermination()
        return kt.keyed_scan(spark, dst, SCHEMA)

    kt.keyed_write(rows(spark, 0, 400), src, F.col("k"), 4)
    assert run().count() == 400
    kt.keyed_write(rows(spark, 400, 700), src, F.col("k"), 4)
    kt.keyed_write(rows(spark, 700, 900), src, F.col("k"), 4)
    for _ in range(2):       # the second restart has nothing new
        got = run()
        assert sorted(r.n for r in got.collect()) == list(range(900))
        check_offsets(got)


def test_files_without_a_commit_are_not_seen_and_a_replay_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "topic")
    kt.keyed_write(rows(spark, 0, 100), path, F.col("k"), 4)
    log = kt._Log(path)
    before, files = log.ends(), log.files({}, log.ends())
    added = [kt.Added(0, [(files[0].partition, files[0].file.removeprefix(log.root + "/"), files[0].hi)])]
    assert kt.keyed_scan(spark, path, SCHEMA).count() == 100
    log.commit("w", "7", added)
    after = log.ends()
    log.commit("w", "7", added)
    assert log.ends() == after != before
    assert sum(p.hi - p.lo for p in log.files(before, after)) == files[0].hi
    assert kt.keyed_scan(spark, path, SCHEMA).count() == 100 + files[0].hi


def test_order_events_round_trip(spark, tmp_path):
    """Decimals and timestamps of a topic's schema come back as they were written."""
    o = tb.orders_stream(spark, SF001)
    tp.write_topic(o, str(tmp_path), tp.ORDERS_PLACED, "order_id", keyed=True)
    back = tp.topic_scan(spark, str(tmp_path), tp.ORDERS_PLACED, keyed=True)
    cols = [f.name for f in tp.ORDER_PLACED.fields]
    assert back.select(*cols).exceptAll(o.select(*cols)).count() == 0 and back.count() == o.count()
