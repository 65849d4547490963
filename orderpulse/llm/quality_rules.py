"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: its words, symbol characters, repeated lines and words inside repeated
5-word windows.  Cross-document rule: lines are normalised (trimmed, lowered) and hashed; for each
host the distinct documents of a line are counted, copies of a text counting once.  A line of more
than ``LINE_LIMIT`` of the host's distinct texts (and of more than ``LINE_FLOOR`` of them) is
boilerplate and is removed from every document but the first that has it, by id.  A document that
loses so much that less than ``LEAST_LEFT`` of its line characters stay is depleted and rejected.

Counts come from partial aggregates, so a line that every document has costs one row a task.  A host
has at most (line entries / limit) boilerplate lines, that is at most lines-per-text / ``LINE_LIMIT``
whatever its size; its lines become one array.  The arrays are broadcast while there are at most
``MAX_BROADCAST_LINES`` lines in all and joined by host beyond that, so texts need no shuffle.

Defined results: null text counts as empty and fails the base rules; a null host is a host of its own;
a document without an id is never the first; repeated rows get equal verdicts; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, saved, words_of

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
LINE_LIMIT = 0.01
LINE_FLOOR = 20
LEAST_LEFT = 0.2
MAX_BROADCAST_LINES = 2_000_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more, the first included."""
    def starts(ordered: Column) -> Column:
        hash_at = lambda k: F.get(ordered, k)["h"]
        twice = F.filter(ordered, lambda x, k: F.coalesce(x["h"] == hash_at(k - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(ordered, starts), length)).otherwise(F.lit(0))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        return F.when(F.size(w) > size, _let(hashes, covered)).otherwise(F.lit(0))

    return _let(words, count)


def _lines(text: Column) -> Column:
    """The lines with a word, as they are."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def boilerplate(docs: DataFrame, host_col: str = "source", line_limit: float = LINE_LIMIT, line_floor: int = LINE_FLOOR) -> DataFrame:
    """(host, hashes, firsts): the boilerplate lines of each host and the smallest id that has each."""
    text = F.coalesce("text", F.lit(""))
    per_line = docs.select(F.col(host_col).alias("host"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("content"),
                           F.explode(F.array_distinct(F.transform(_lines(text), lambda x: F.xxhash64(_normal(x))))).alias("line"))
    per_text = per_line.groupBy("host", "line", "content").agg(F.min("id").alias("first"))
    counted = per_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") > line_floor)
    sizes = (docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("content")).groupBy("host", "content").agg(F.lit(1).alias("one"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("texts")))
    over = counted.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))).where(F.col("n") > F.col("texts") * line_limit)
    return over.groupBy(F.col("c.host").alias("host")).agg(F.array_sort(F.collect_list(F.struct("line", "first"))).alias("lines"))


def _with_lines(docs: DataFrame, host_col: str, **limits) -> tuple[DataFrame, str]:
    """``docs`` with its host's boilerplate lines."""
    lines = saved(boilerplate(docs, host_col, **limits))
    total = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    host, name = fresh(docs, "line_host"), fresh(docs, "host_lines")
    lines = lines.select(F.col("host").alias(host), F.col("lines").alias(name))
    joined = docs.join(F.broadcast(lines) if total <= MAX_BROADCAST_LINES else lines, docs[host_col].eqNullSafe(lines[host]), "left")
    return joined.drop(host), name


def _is_removed(line: Column, found: Column, doc_id: Column) -> Column:
    """Whether a line is boilerplate that an earlier document of the host has."""
    def at(place: Column) -> Column:
        first = F.get(found["first"], (place - 1).cast("int"))
        return (place > 0) & ~F.coalesce(first == doc_id, F.lit(False))
    return F.coalesce(_let(F.array_position(found["line"], F.xxhash64(_normal(line))), at), F.lit(False))


def _chars(lines: Column, counts=None) -> Column:
    """Characters of those ``lines`` that ``counts`` takes, all by default."""
    each = F.transform(lines, lambda x: (F.length(x) if counts is None else F.when(counts(x), F.length(x)).otherwise(F.lit(0))).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def _removed_chars(lines: Column, found: Column, doc_id: Column) -> Column:
    return F.when(found.isNull(), F.lit(0).cast("long")).otherwise(_chars(lines, lambda x: _is_removed(x, found, doc_id)))


def _depleted(line_chars: Column, removed_chars: Column) -> Column:
    return (removed_chars > 0) & (line_chars - removed_chars < LEAST_LEFT * line_chars)


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def measures(docs: DataFrame, host_col: str = "source", **limits) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_chars,
    removed_chars for every row."""
    joined, found = _with_lines(docs.select("doc_id", "text", F.col(host_col)), host_col, **limits)
    text = F.coalesce("text", F.lit(""))
    d = joined.select("doc_id", F.col(found).alias("found"), words_of(F.col("text")).alias("words"), _lines(text).alias("lines"),
                      F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"))
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), _chars(F.col("lines")).alias("line_chars"),
                 _removed_chars(F.col("lines"), F.col("found"), F.col("doc_id")).alias("removed_chars"))
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    (~failed & ~_depleted(F.col("line_chars"), F.col("removed_chars"))).alias("kept"), "line_chars", "removed_chars")


def clean(docs: DataFrame, host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, without the lines that the rule removes; columns as in ``docs``."""
    joined, found = _with_lines(docs, host_col, **limits)
    gone = fresh(joined, "gone_chars")

    def loss(lines: Column) -> Column:   # characters removed, -1 for a depleted document
        removed = _removed_chars(lines, F.col(found), F.col("doc_id"))
        return _let(removed, lambda r: F.when(_depleted(_chars(lines), r), F.lit(-1).cast("long")).otherwise(r))

    d = joined.where(~_let(words_of(F.col("text")), lambda w: _base_failed(F.size(w), repeated_words(w))))
    d = d.withColumn(gone, _let(_lines(F.coalesce("text", F.lit(""))), loss)).where(F.col(gone) >= 0)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~_is_removed(x, F.col(found), F.col("doc_id"))), "\n")
    put = {"text": F.when(F.col(gone) > 0, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col(gone) > 0, F.length(left)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[(put[c] if c in put else F.col(f"`{c}`")).alias(c) for c in docs.columns])
