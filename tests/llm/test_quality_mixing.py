"""Ops 3 and 5 against brute force on small fixtures."""
import collections
import hashlib
import random

from orderpulse.llm import mixing, quality_rules

SCHEMA = "doc_id long, text string, source string, size int, host_lines string, mix_copy int, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, len(t or "")) for i, t, s in rows], SCHEMA)


def words(t):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]


def repeat_words(w, n=5):
    at = collections.defaultdict(list)
    for i in range(len(w) - n + 1):
        at[tuple(w[i:i + n])].append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + n)})


def quality_rows():
    r = random.Random(5)
    rows = [(None, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "one two", "a"), (4, "a b c d e " * 40, "b"), (5, "x " * 30000, "b")]
    for i in range(40):
        own = "\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(12)) for _ in range(r.randint(1, 3)))
        rows.append((10 + i, f"{own}\n  Shared LINE of the host, all rights kept by us here\n{own[:20]}#*$", "h"))
    rows += [(100 + i, f"shared line of the host, all rights kept by us here\n{i}", "h") for i in range(5)]
    rows += [(200, rows[10][1], "h"), (200, rows[10][1], "h")]
    return rows


def test_quality(spark):
    rows = quality_rows()
    got = quality_rules.measures(frame(spark, rows), line_floor=3)
    by = collections.Counter(map(tuple, got.collect()))
    texts, first = collections.defaultdict(set), {}
    hosts = collections.defaultdict(set)
    for i, t, s in rows:
        hosts[s].add(t or "")
        for x in (t or "").split("\n"):
            if words(x):
                k = (s, x.strip(" ").lower())
                texts[k].add(t)
                first[k] = min((j for j in (first.get(k), i) if j is not None), default=None)
    often = {k for k, v in texts.items() if len(v) > 3 and len(v) > 0.01 * len(hosts[k[0]])}
    assert often
    want = []
    for i, t, s in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        gone = sum(len(x) for x in lines if (k := (s, x.strip(" ").lower())) in often and (i is None or first[k] != i))
        total, rep = sum(map(len, lines)), repeat_words(w)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, failed,
                     not failed and not (gone > 0 and total - gone < 0.2 * total), total, gone))
    assert by == collections.Counter(want)
    assert any(not x[6] and not x[7] for x in want)   # a depleted document
    docs = frame(spark, rows)
    kept = quality_rules.clean(docs, line_floor=3)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(x[0]) for x in want if x[7])
    holders = [r.doc_id for r in out if any(x.strip(" ").lower().startswith("shared line") for x in r.text.split("\n"))]
    assert holders == [10]
    assert quality_rules.measures(docs.limit(0)).count() == 0 and quality_rules.clean(docs.limit(0)).count() == 0


def water(sizes, weights):
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        width = sum(weights[s] for s in free)
        over = {s: 3 * sizes[s] for s in free if rest * weights[s] > 3 * sizes[s] * width}
        if not over:
            return {s: capped.get(s) if s in capped else rest * weights[s] / width for s in sizes}
        capped |= over


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), s) for i, s in enumerate(r.choices([None, "a", "b", "é", "z"], [1, 8, 200, 3, 40], k=400))]
    rows += [(1000, None, "a"), (1001, "", "only empty"), (None, "x y z", "b"), (5, rows[5][1], rows[5][2])]
    got = mixing.plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    goal = water(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = collections.Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - goal[x.source]) < 1e-6 * max(1, goal[x.source])
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(frame(spark, rows)).collect()))
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter((x.doc_id, x.text, x.source) for x in mixed.collect())
    least = {(x.doc_id, x.source): -(-x.taken // x.size) if x.size else 0 for x in got}
    for (i, t, s), n in copies.items():
        if (i, s) != (5, rows[5][2]):
            assert n == least[i, s]
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_without_words(spark):
    docs = frame(spark, [(1, "", "a"), (2, None, "b")])
    assert [(r.taken, r.target) for r in mixing.plan(docs).collect()] == [(0, 0.0), (0, 0.0)]
    assert hashlib and mixing.mix(docs).count() == 0
