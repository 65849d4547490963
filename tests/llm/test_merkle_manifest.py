"""Op 12 against a plain tree, at group sizes that need several rounds."""
import hashlib
import random
import zlib

import pytest
from orderpulse.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, i long, n long, hash string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    parts = [None if v is None else str(v) for v in (i, source, lang, n, text)]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """What the manifest must be, by whole levels."""
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = levels([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, _, h, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            proof = ""
            for tree, at in ((built[s], j), (top, k)):
                for nodes in tree[:-1]:
                    first = at // 3 * 3
                    left, right = "".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])
                    proof, now, at = proof + left + right, sha(left + now + right), at // 3
            out.append((str(r[0]), h, built[s][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out)


def check(spark, rows, levels=mm.LEVELS):
    got = mm.manifest(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA), mm.without_newlines(), levels)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()) == plain(rows)


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    rows = [(i, f"line {i}\nmore" if i % 3 else "no line end", "en", f"s{i % 2}", 5) for i in range(40)]
    rows += [(None, None, None, None, None), (7, "same id\n", "de", "s1", 1), (7, "same id\n", "de", "s1", 1), (90, "", None, "é", 0),
             (91, "\n" * 200_000, "en", "Z", 200_000), (92, "alone\n", "en", "", 1)]
    check(spark, rows)


@pytest.mark.parametrize("count", [1, 26, 244])
def test_many_rounds(spark, count):
    """Groups of nine leaves: 244 rows of one source take three rounds, 30 sources two in the top tree."""
    rnd = random.Random(count)
    rows = [(rnd.randrange(1000), "a\nb" * rnd.randrange(3), "en", "hot" if k % 3 else f"s{rnd.randrange(30)}", k) for k in range(count)]
    check(spark, rows, levels=2)


def test_empty_table(spark):
    assert mm.manifest(spark.createDataFrame([], SCHEMA), mm.without_newlines()).collect() == []


@pytest.mark.parametrize("height,extra", [(0, 0), (1, 0), (3, 0), (3, 2)])
def test_positions_are_those_of_the_log(height, extra):
    """Every node is where the closed form says, also in groups that are carried up higher than they need."""
    for n in range(1, mm.RUN ** height + 1):
        h = height + extra if extra else mm.height_of(n)
        names = [str(k) for k in range(n)]
        log = mm.append_log(names, h)
        nodes = names
        for level in range(h + 1):
            if level:
                nodes = [mm.digest_of("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
            assert [log[mm.position(n, h, level, k)] for k in range(len(nodes))] == nodes
        assert len(log) == sum(-(-n // 3 ** level) for level in range(h + 1))


def test_files_of_saved_tables_follow_the_rows(spark, monkeypatch):
    """Logs and the result have no more parts than cores for few rows, whatever the shuffle partitions; the manifest is the same."""
    cores, counts = spark.sparkContext.defaultParallelism, []

    def recorded(df, files=None, f=mm.saved):
        out = f(df) if files is None else f(df, files)
        counts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(mm, "saved", recorded)
    rows = [(i, "a\nb", "en", "hot" if i % 3 else f"s{i % 5}", i) for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(cores + 9))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = mm.manifest(docs, mm.without_newlines(), 2)
        counts.append(got.rdd.getNumPartitions())
        out = got.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out) == plain(rows)
    assert len(counts) > 7 and max(counts) <= cores
