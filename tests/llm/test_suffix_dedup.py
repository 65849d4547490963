"""Op 13 against all strings of the length, counted one by one."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from orderpulse.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, sha string, key long, n long, id long, spans string"


def plain(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + 200] for _, b in raw for k in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, "x") for i, t in rows], SCHEMA)
    got = sd.digest(sd.spans(docs, **how)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(rows)


def prose(rnd, n):
    return "".join(rnd.choice("abcdefgh é日") for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    passage, near = prose(rnd, 400), prose(rnd, 700)
    rows = [(k, prose(rnd, rnd.randrange(300)) + passage[rnd.randrange(100):300 + rnd.randrange(100)] + prose(rnd, rnd.randrange(300))) for k in range(12)]
    rows += [(20 + k, near[:100 * k] + "#" + near[100 * k:]) for k in range(6)]     # near copies
    rows += [(40, passage), (41, passage), (42, passage[:199]), (43, passage[:199])]
    rows += [(50, prose(rnd, 3) + passage[:150] + "!" + passage[150:] + passage[:90])]
    rows += [(60, "a" * 1000), (61, "ab" * 300), (62, "a" * 199), (63, "xyz" * 70 + prose(rnd, 50)), (64, "c" * 200 + prose(rnd, 50))]
    rows += [(70, None), (71, ""), (None, prose(rnd, 500)), (72, None), (7, "same " * 50), (7, "same " * 50), (None, "q" * 250)]
    return rows


@pytest.mark.parametrize("how", [{}, {"max_pieces": 2}])
def test_against_all_strings(spark, how):
    """With two pieces a group nearly every group is split by offset, down to single windows."""
    check(spark, corpus(3), **how)


def test_hot_passage_and_hot_copies(spark, monkeypatch):
    """Half of the rows share a passage and a fifth are one text; the tables of hot keys are in use."""
    monkeypatch.setattr(sd, "HOT_ROWS", 5)
    rnd = random.Random(5)
    passage, copy = prose(rnd, 350), prose(rnd, 300)
    rows = [(k, (prose(rnd, 40) + passage + prose(rnd, 60)) if k % 2 else copy if k % 5 == 0 else prose(rnd, 260)) for k in range(60)]
    check(spark, rows, max_pieces=8)


def test_empty_and_short_tables(spark):
    check(spark, [])
    check(spark, [(1, "short"), (2, "short"), (3, None)])


def test_one_long_text(spark):
    rnd = random.Random(8)
    part = prose(rnd, 900)
    check(spark, [(1, prose(rnd, 30_000) + part + prose(rnd, 20_000) + part[100:]), (2, prose(rnd, 500))])


def test_parts_of_a_text_have_the_anchors_of_the_whole(monkeypatch):
    u = np.frombuffer(prose(random.Random(2), 5000).encode() + b"a" * 700, np.uint8)
    def anchors():
        return [a for first, last, anchor, _ in sd.anchored(u) for i, j, a in zip(first, last, anchor) for _ in range(i, j + 1)]
    whole = anchors()
    assert len(whole) == len(u) - 199 and all(i <= a <= i + 100 for i, a in enumerate(whole))
    monkeypatch.setattr(sd, "CHUNK", 777)
    assert anchors() == whole


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_of_shards(shards):
    """The interleave of any number of shards finds what counting finds."""
    rnd = random.Random(shards)
    base = prose(rnd, 300).encode()
    pieces = [base[rnd.randrange(40):260 + rnd.randrange(40)] for _ in range(11)] + [b"a" * 230, b"a" * 200, base[:200], b"z" * 200]
    seen = Counter(p[k:k + 200] for p in pieces for k in range(len(p) - 199))
    got = sd.merged([pieces[s::shards] for s in range(shards)])
    order = [p for s in range(shards) for p in pieces[s::shards]]
    assert [g.tolist() for g in got] == [[seen[p[k:k + 200]] > 1 for k in range(len(p) - 199)] for p in order]


def test_equal_hashes_of_unequal_strings(monkeypatch):
    """Bytes decide where hashes took two strings for one."""
    monkeypatch.setattr(sd, "hashes", lambda u, size: np.zeros(max(0, len(u) - size + 1), np.uint64))
    got = sd.merged([[b"a" * 200, b"b" * 200], [b"b" * 200, b"c" * 200]])
    assert [g.tolist() for g in got] == [[False], [True], [True], [False]]
