"""Op 11 against plain counting, with forced collisions, several blocks of sources, nulls and ties."""
import random
import re
from collections import Counter, defaultdict

import pytest
from orderpulse.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, l long, g long, part string, term string"


def plain(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
            for lang, source, text in rows]
    groups, counts, df = {(x, y) for x, y, _ in docs}, defaultdict(Counter), defaultdict(Counter)
    for x, y, terms in docs:
        counts[x, y].update(terms)
        counts[x, None].update(terms)
        df[x].update(set(terms))
    kept = {x: {t for t, n in c.items() if n >= least} for x, c in df.items()}

    def p(x, y, t):
        total = sum(counts[x, y][k] for k in kept[x])
        return 1 + 10**9 * (counts[x, y][t] + 5) // (total + 5 * len(kept[x]))

    out = []
    for x, y in groups:
        pair = [(sum(abs(p(x, y, t) - p(x, o, t)) for t in kept[x]), o) for z, o in groups if z == x and o != y]
        term = [(p(x, y, t) - p(x, None, t), t) for t in kept[x] if counts[x, y][t] and p(x, y, t) > p(x, None, t)]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            order = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
            out += [(x, y, part, item, value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


def check(spark, rows, least, top, bits=64):
    docs = spark.createDataFrame([(i, *r, 1, 2, "x", "y") for i, r in enumerate(rows)], SCHEMA)
    got = divergence.audit(docs, least, top, bits)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, least, top)


def corpus(n, sources, seed=1):
    rnd = random.Random(seed)
    words = ["the", "The", "Éa", "éa", "naïve", "a1b", "x-y", "ü", "日本", "z" * 300, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rnd.choice(["en", "de"]), "hot" if k % 3 == 0 else f"s{rnd.randrange(sources)}", " ".join(rnd.choices(words, k=rnd.randrange(12)))) for k in range(n)]
    return rows + [(None, None, None), (None, "", "the"), ("fr", "only", "un deux"), ("en", "empty", ""), ("en", "digits", "1 2 3"), ("en", "hot", "the " * 5)] * 2


@pytest.mark.parametrize("bits", [64, 3])
def test_against_plain_counts(spark, bits):
    """With digests of three bits nearly all terms collide and are told apart by their strings."""
    check(spark, corpus(150, 4), 6, 5, bits)


def test_several_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_PER_BLOCK", 3)
    monkeypatch.setattr(divergence, "TERMS_PER_SLICE", 4)
    check(spark, corpus(200, 9), 5, 50)


def test_no_kept_terms_and_empty_table(spark):
    check(spark, corpus(20, 3), 1000, 5)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_at_the_last_rank(spark):
    check(spark, [("en", s, t) for s in "ab" for t in ("p q r s" if s == "a" else "v w x y", "common")], 1, 2)


def test_strings_move_only_for_kept_terms(spark, capsys):
    """The exchange that counts documents carries numbers alone."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "g long, text string").selectExpr("g AS l", "g", "text")
    divergence.counted(docs).groupBy("l", "d").agg({"docs": "sum"}).explain("formatted")
    exchanges = [x for x in capsys.readouterr().out.split("\n\n") if "Exchange" in x and "Input" in x]
    assert exchanges and all("term" not in x for x in exchanges)


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 16)
    text = "Abc déf " * 1000 + "x" * 100
    assert divergence.terms_of(text) == Counter({b"abc": 1000, "déf".encode(): 1000, b"x" * 100: 1})
    assert divergence.terms_of(None) == Counter()
