"""Divergence of the term frequencies of sources, with late string materialization.

1. A task counts the terms of its texts and writes (language, group, term digest, occurrences, documents, term);
   a group is a (lang, source).  Digests (of language and term) and keys are 64-bit numbers.
2. Only the numbers are shuffled: documents of a digest in its language.  A digest under ``LEAST_DOCUMENTS`` has
   no term to keep, so its strings never move.
3. For the digests left, the minimum and the maximum of their strings are found.  Where they differ, several
   terms share the digest, and it is split: its rows are counted again by string.  Elsewhere the minimum is the term.
4. Frequencies, differences and ranks are worked out on digests; strings are joined to the rows that may be put out.

Pairs of sources: a term's frequencies of one block of sources are a row; blocks meet in pairs for a slice
of ``TERMS_PER_SLICE`` terms, where numpy adds the differences, so no task holds more than a slice of two blocks.
A pair's sum over the terms that neither source has is a product.

A term that every document has costs one row for each task and group.  Tables that may be broadcast are counted
first (``common.lookup``).  All arithmetic is in whole numbers.

Defined results: null text, lang and source count as ''; a group without kept terms has only its pairs; a
language with one source has no pair; repeated rows are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import ship_package
from .common import lookup, map_rows, saved, written

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
DIGEST_BITS = 64
SOURCES_PER_BLOCK, TERMS_PER_SLICE = 128, 512
#: Bytes of terms that a task counts before it writes them out, and of a text that is split at once.
COUNTED_BYTES, CHUNK = 192 << 20, 4 << 20
#: Digests (one number each) that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_DIGESTS = 1_000_000

#: Letters and all bytes above ASCII make terms; A-Z are lowered and any other byte separates.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ENTRY_BYTES = 200


def terms_of(text: str | None) -> Counter[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS)
    if len(raw) <= CHUNK:
        return Counter(raw.split())
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def digest(lang: int, term: bytes, bits: int = DIGEST_BITS) -> int:
    """The term's signed digest in its language."""
    d = xxh3_64_intdigest(term, lang & 0xFFFFFFFFFFFFFFFF)
    return (d - (1 << 64) if d >> 63 else d) >> (64 - bits)


def counted(docs: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """(l, g, d, n, docs, term) of the terms that a task found, from ``docs`` (l, g, text)."""
    names = ["l", "g", "d", "n", "docs", "term"]
    ship_package(docs.sparkSession)

    def rows(table: dict[tuple[int, int], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for (lang, group), terms in table.items():
            every, counts = list(terms), list(terms.values())
            for at in range(0, len(every), 50_000):
                part = every[at:at + 50_000]
                n = np.array(counts[at:at + 50_000], np.int64)
                cols = [np.full(len(part), lang), np.full(len(part), group), np.array([digest(lang, t, bits) for t in part], np.int64), n[:, 0], n[:, 1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(part, pa.binary()).cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        held = 0
        for batch in batches:
            for lang, group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seen = table.setdefault((lang, group), {})
                for term, n in terms_of(text.as_py()).items():
                    if (entry := seen.get(term)) is None:
                        seen[term] = [n, 1]
                        held += len(term) + _ENTRY_BYTES
                    else:
                        entry[0] += n
                        entry[1] += 1
                if held > COUNTED_BYTES:
                    yield from rows(table)
                    table, held = {}, 0
        yield from rows(table)

    return docs.select("l", "g", "text").mapInArrow(run, "l long, g long, d long, n long, docs long, term string")


def _groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, l, g) of every group, and the seed that gives each lang and group a number of its own."""
    names = saved(docs.select("lang", "source").distinct())
    want = names.agg(F.countDistinct("lang").alias("l"), F.count(F.lit(1)).alias("g")).first()
    seed = 0
    while True:
        groups = names.select("*", *_keys(seed))
        if groups.agg(F.countDistinct("l").alias("l"), F.countDistinct("g").alias("g")).first() == want:
            return groups, seed
        seed += 1


def _keys(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g")]


def frequency(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) of three columns, in whole numbers."""
    over = f"cast({n} + {PRIOR} as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))"
    return F.expr(f"1 + {over} div cast({total} + {PRIOR} * {terms} as decimal(20, 0))")


def kept_counts(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(l, g, d, part, n) of the kept terms in each group, their (l, d, part, all_n) and (l, d, part, term).
    ``part`` tells terms of one digest apart and is '' where a digest has one term."""
    often = parts.groupBy("l", "d").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    often = saved(often.select("d").distinct())
    often = F.broadcast(often) if often.count() <= MAX_BROADCAST_DIGESTS else often
    mine = parts.join(often, "d", "left_semi")
    # counting keeps the first step, which combines equal strings in the task by hash
    names = mine.groupBy("l", "d", "term").agg(F.count(F.lit(1)).alias("rows"))
    names = saved(names.groupBy("l", "d").agg(F.min("term").alias("low"), F.max("term").alias("high"), F.sum("rows").alias("rows")))
    splits = saved(names.where("low != high").select("l", "d", F.lit(True).alias("split")))
    if splits.isEmpty():
        named = mine.select("l", "g", "d", F.lit("").alias("part"), "n", "docs")
    else:
        named = mine.join(lookup(splits), ["l", "d"], "left").select("l", "g", "d", F.when(F.col("split"), F.col("term")).otherwise("").alias("part"), "n", "docs")
    counts = saved(named.groupBy("l", "g", "d", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    sums = saved(counts.groupBy("l", "d", "part").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")))
    under = lookup(saved(sums.where(F.col("docs") < least).select("l", "d", "part")))   # only terms that share a digest
    kept = counts.join(under, ["l", "d", "part"], "left_anti").drop("docs")
    of_lang = sums.where(F.col("docs") >= least).drop("docs")
    strings = of_lang.join(names, ["l", "d"]).select("l", "d", "part", F.when(F.col("part") == "", F.col("low")).otherwise(F.col("part")).alias("term"))
    return kept, of_lang, strings


def _numbered(d: np.ndarray, part: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each entry's term, from 0, and how many there are."""
    if not pc.any(pc.not_equal(part, "")).as_py():   # no digest with several terms
        of, row = np.unique(d, return_inverse=True)
        return row, len(of)
    ids: dict[tuple, int] = {}
    return np.array([ids.setdefault(t, len(ids)) for t in zip(d.tolist(), part.to_pylist())]), len(ids)


def _pair_sums(entries: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(g, other, extra), g's place being before other's: the sum of abs(p - q) - abs(p0 - q0) over the terms
    that either has, where p0 and q0 are the frequencies of a term that a source does not have."""
    block = F.floor(F.col("place") / SOURCES_PER_BLOCK).cast("int")
    groups = groups.withColumn("block", block)
    lists = groups.groupBy("l", "block").agg(F.array_sort(F.collect_list(F.struct("place", "g", "p0"))).alias("of"))
    lists = lookup(saved(lists))
    e = entries.join(lookup(groups.select("g", "place", "block")), "g").join(lookup(langs), "l")
    last = F.floor((F.col("sources") - 1) / SOURCES_PER_BLOCK).cast("int")
    piece = F.pmod(F.xxhash64("d", "part"), F.ceil(F.col("terms") / TERMS_PER_SLICE)).alias("piece")
    e = e.select("l", "d", "part", (F.col("place") % SOURCES_PER_BLOCK).cast("int").alias("at"), "p", "block", piece,
                 F.explode(F.sequence(F.lit(0), last)).alias("other"))
    item = F.struct((F.col("block") > F.col("other")).alias("second"), "d", "part", "at", "p")
    squares = e.groupBy("l", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "piece").agg(F.collect_list(item).alias("items"))
    for side in ("a", "b"):
        squares = squares.join(lists.select("l", F.col("block").alias(side), F.col("of").alias(f"of_{side}")), ["l", side])
    columns = [F.col(c) for c in ("items.second", "items.d", "items.part", "items.at", "items.p", "of_a.g", "of_a.p0", "of_b.g", "of_b.p0")]
    squares = squares.select("a", "b", *(c.alias(f"c{k}") for k, c in enumerate(columns)))

    def make():
        def f(x: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"g": [], "other": [], "extra": []}
            lists = [(c.offsets.to_numpy(), c.values) for c in x.columns[2:]]
            for r, (a, b) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
                second, d, part, at, p, of_a, base_a, of_b, base_b = (v[o[r]:o[r + 1]] for o, v in lists)
                second, d, at, p, of_a, base_a, of_b, base_b = (v.to_numpy(zero_copy_only=False) for v in (second, d, at, p, of_a, base_a, of_b, base_b))
                row, terms = _numbered(d, part)
                first, other = np.tile(base_a, (terms, 1)), np.tile(base_b, (terms, 1))
                first[row[~second], at[~second]] = p[~second]
                mine = second if a != b else ~second
                other[row[mine], at[mine]] = p[mine]
                for i, g in enumerate(of_a):
                    start = i + 1 if a == b else 0
                    sums = np.abs(first[:, i:i + 1] - other[:, start:]).sum(0) - terms * np.abs(base_a[i] - base_b[start:])
                    out["extra"] += sums.tolist()
                    out["other"] += of_b[start:].tolist()
                    out["g"] += [g] * len(sums)
            return out
        return f

    sums = map_rows(squares, make, "g long, other long, extra long", 64)
    return sums.groupBy("g", "other").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) its distance to each other source of the
    language (part ``pair``) and its ``top`` terms that are more frequent than in the language (part ``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups, seed = _groups(docs)
    parts = written(counted(docs.select(*_keys(seed), "text"), bits))
    counts, of_lang, terms = kept_counts(parts, least)

    langs = of_lang.groupBy("l").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    sizes = groups.groupBy("l").agg(F.count(F.lit(1)).alias("sources")).join(langs, "l", "left").na.fill(0)
    sizes = saved(sizes)
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, "g", "left").na.fill(0, ["total"]).join(sizes.select("l", "terms"), "l")
    place = F.row_number().over(Window.partitionBy("l").orderBy("source")) - 1
    p0 = F.when(F.col("terms") > 0, frequency("0L", "total", "terms")).otherwise(0)
    groups = saved(groups.select("lang", "source", "l", "g", "total", "terms", p0.alias("p0"), place.alias("place")))

    entries = counts.join(lookup(groups.select("g", "total", "terms")), "g")
    entries = saved(entries.select("l", "g", "d", "part", frequency("n", "total", "terms").alias("p")))
    one = groups.select("l", "lang", "source", "g", "p0", "place", "terms")
    two = groups.select("l", F.col("source").alias("item"), F.col("g").alias("other"), F.col("p0").alias("q0"), F.col("place").alias("place2"))
    sums = _pair_sums(entries, groups.select("l", "g", "place", "p0"), sizes.select("l", "sources", "terms"))
    sums = saved(sums.unionByName(sums.select(F.col("other").alias("g"), F.col("g").alias("other"), "extra")))
    pairs = one.join(two, "l").where("place != place2").join(sums, ["g", "other"], "left")
    value = F.coalesce("extra", F.lit(0)) + F.col("terms") * F.abs(F.col("p0") - F.col("q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    q = of_lang.join(lookup(sizes.select("l", "all_total", F.col("terms").alias("v"))), "l").select("l", "d", "part", frequency("all_n", "all_total", "v").alias("q"))
    more = entries.join(q, ["l", "d", "part"]).where("p > q").select("l", "g", "d", "part", (F.col("p") - F.col("q")).alias("value"))
    best = more.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("place") <= top)
    best = saved(best.drop("place"))   # ties at the last place are all here until their strings are known
    named = best.join(terms, ["l", "d", "part"]).join(lookup(groups.select("g", "lang", "source")), "g")
    named = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(named.withColumn("rank", rank).where(F.col("rank") <= top))
