"""Ops 8 and 9 against brute force, with nulls, ties, clashing columns and empty tables."""
import hashlib
import itertools
import random

from orderpulse.llm import bloom, exact_dedup, near_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, block0 string, sha string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y", 7) for i, t in rows], SCHEMA)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


EXACT = [(1, "Hello"), (2, "hELLO"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 50000), (9, "X" * 50000), (9, "X" * 50000), (None, "hello"), (11, "alone")]


def test_exact_groups(spark):
    got = exact_dedup.groups(frame(spark, EXACT)).collect()
    assert len(got) == len(EXACT)
    for text in {fold(t) for _, t in EXACT}:
        ids = [i for i, t in EXACT if fold(t) == text]
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert {r.keep_id for r in rows} == {keep} and {r.group_size for r in rows} == {len(ids)}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_rows_of_one_text_are_not_dealt_to_one_task(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i // 6}") for i in range(6000)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = frame(spark, rows).repartition(4)
        got = exact_dedup.groups(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(r.doc_id for r in got) == list(range(6000))
    same = [r for r in got if r.doc_id % 3]
    assert {(r.group_size, r.keep_id) for r in same} == {(4000, 5999)} and [r.doc_id for r in same if r.kept] == [5999]
    assert len({r.task for r in same}) > 1
    assert all(r.group_size == sum(1 for x in range(0, 6000, 3) if x // 6 == r.doc_id // 6) for r in got if not r.doc_id % 3)


def test_exact_dedup_rows(spark):
    docs = frame(spark, EXACT)
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, fold(r.text)) for r in got.collect()) == sorted([(2, "hello"), (3, "É"), (4, "é"), (6, ""), (9, "x" * 50000), (11, "alone")])
    assert exact_dedup.dedup(docs.limit(0)).count() == 0 and exact_dedup.groups(docs.limit(0)).count() == 0


def shingles(text, n):
    w = fold(text).split(" ") if text and text.strip(" ") else []
    w = [x for x in w if x]
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice((3, 12, 60, 150)))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "ONE two"), (5, "one two three")]
    for b in base:
        for _ in range(r.choice((1, 2, 30))):
            c = list(b)
            for _ in range(r.choice((0, 1, 2, 4))):
                c[r.randrange(len(c))] = r.choice(words)
            rows.append((len(rows), " ".join(c)))
    r.shuffle(rows)
    return rows


def test_near_groups(spark):
    for seed, n in ((1, 4), (2, 5)):
        rows = near_rows(seed)
        got = {r.doc_id: r for r in near_dedup.groups(frame(spark, rows), shingle=n).collect()}
        want = brute(rows, n)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_block_pairs_of_one_cluster_spread(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{r.randrange(10 ** 9)}"])) for i in range(1100)]
    docs = frame(spark, rows).select("doc_id", "text")
    ids = docs.select(F.col("doc_id").alias("id"))
    roots = ids.where("id < 150").select("id", F.lit(0).cast("long").alias("root"))   # one component of 150, the others alone
    bridges = ids.where("id >= 150").select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = near_dedup._between(bridges, ids, roots, docs, 5, "doc_id", "text").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    root = lambda i: 0 if i < 150 else i
    assert {(x.a, x.b) for x in links} == {(a, b) for a in range(1100) for b in range(150, 1100) if root(a) != root(b)}
    assert len(links) == len({(x.a, x.b) for x in links}) and len({x.task for x in links}) > 1


def test_block_pairs_are_whole(spark):
    for n, n2 in ((1, 1), (4, 5), (9, 2)):
        a = spark.createDataFrame([(7, i, n2, i) for i in range(n)], "g int, block int, n2 int, items int")
        b = spark.createDataFrame([(7, i, n, i) for i in range(n2)], "g int, block2 int, n int, items2 int")
        assert sorted(map(tuple, near_dedup._block_pairs(a, b, "g").collect())) == sorted(itertools.product(range(n), range(n2)))
        a, b = a.withColumn("n2", F.lit(n)), a.select("g", F.col("block").alias("block2"), F.lit(n).alias("n"), F.col("items").alias("items2"))
        assert sorted(map(tuple, near_dedup._block_pairs(a, b, "g", once=True).collect())) == sorted(itertools.combinations_with_replacement(range(n), 2))


def test_near_edges(spark):
    rows = [(None, "a b c d e f"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "a b c d e f")]
    docs = frame(spark, rows)
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.groups(docs).collect())
    assert got == [("8", 8, True), ("8", 8, True), ("9", 8, False), ("None", None, True)]
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["8", "8", "None"]
    assert near_dedup.groups(docs.limit(0)).count() == 0


def test_a_text_is_hashed_once_in_each_branch(spark):
    """The digest is not computed again for the null check of the join on it."""
    plan = exact_dedup.dedup(frame(spark, EXACT))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_files_of_saved_tables_follow_the_rows(spark, monkeypatch):
    """Tables after a shuffle have no more files than cores for few rows, whatever the shuffle partitions."""
    cores, counts = spark.sparkContext.defaultParallelism, []
    for module in (bloom, exact_dedup, near_dedup):
        def recorded(df, files=None, f=module.saved, of=module.__name__):
            out = f(df) if files is None else f(df, files)
            counts.append((of, files, out.rdd.getNumPartitions()))
            return out
        monkeypatch.setattr(module, "saved", recorded)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i % 3:] + [str(i // 3)])) for i in range(60)] + EXACT
    docs = frame(spark, rows).repartition(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(cores + 9))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        exact_dedup.groups(docs).count()
        exact_dedup.dedup(docs).count()
        near_dedup.dedup(docs).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    many = [c for c in counts if c[2] > cores]
    assert len(counts) > 15
    assert len(many) <= 2 and {c[0] for c in many} <= {near_dedup.__name__}   # full sets compared, in as many tasks as may be
