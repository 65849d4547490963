"""Exact deduplication with a two-pass Bloom filter.

Texts are equal when they agree after lowering A-Z.  Pass 1 hashes every text once and marks a
few places of a bit table for it; a place that is hit twice or more goes to the second filter.
Pass 2 looks every hash up there: a text all of whose places were hit twice is possibly repeated,
any other is certainly unique.  Only possibly repeated rows are shuffled and grouped by their full
SHA-256, so false positives cost a little work and never a wrong answer; all other rows pass
straight through.

The hits of a place are counted by a partial aggregate, so a text that a third of all rows share
costs one row per task (``bloom.py``); its rows find their group in a broadcast table.

Defined results: null counts as empty, and all empty texts are one group; of equal texts the row
with the largest id stays (a null id is the smallest), and of rows that also share the id one
stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .bloom import PlaceFilter
from .common import ROWS_AT_ONCE, files_for, fresh, map_rows, saved


#: A text with more copies than this, and more than its share of this many texts, is not joined by a shuffle.
HOT_COPIES, MAX_HOT_TEXTS = 1000, 10_000
#: Rows of the input whose repeated texts fill a file.
ROWS_PER_FILE = 20_000


def _digests(text: pa.Array) -> pa.Array:
    """SHA-256 of each text with A-Z lowered (null: empty), from its bytes and a slice at a time."""
    raw, out = text.cast(pa.binary()), []
    for at in range(0, len(raw), ROWS_AT_ONCE):
        out += [hashlib.sha256((t or b"").lower()).digest() for t in raw.slice(at, ROWS_AT_ONCE).to_pylist()]
    return pa.array(out, pa.binary())


#: Called deterministic, it would run again in the null check that a join on its result puts below it, in more Python workers.
_sha256 = F.arrow_udf(_digests, BinaryType()).asNondeterministic()


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha) of every row: SHA-256 of the normalised whole text."""
    def make():
        return lambda b: {"id": b.column(0), "sha": _digests(b.column(1))}
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), make, "id long, sha binary")


def _stays(maybe: DataFrame) -> DataFrame:
    """(g_sha, stays(id, row), n) of each possibly repeated text."""
    stays = F.max(F.struct(F.col("id"), F.col("row")))   # a null id sorts below any other
    return maybe.groupBy(F.col("sha").alias("g_sha")).agg(stays.alias("stays"), F.count(F.lit(1)).alias("n"))


def _with_stays(maybe: DataFrame, stays: DataFrame) -> DataFrame:
    """``maybe`` with the row of its text in ``stays``.  Rows of a text with very many copies meet a
    broadcast table and are not shuffled; the others are joined on their digest."""
    total = stays.agg(F.sum("n")).first()[0] or 0
    many = max(HOT_COPIES, total // MAX_HOT_TEXTS)
    hot = stays.where(F.col("n") > many)   # fewer than MAX_HOT_TEXTS texts, as each has more than its share
    of_hot = maybe.join(F.broadcast(hot), maybe["sha"] == hot["g_sha"])
    few = stays.where(F.col("n") <= many)
    rest = maybe.join(F.broadcast(hot.select(F.col("g_sha").alias("hot_sha"))), F.col("sha") == F.col("hot_sha"), "left_anti")
    return of_hot.unionByName(rest.join(few, F.col("sha") == F.col("g_sha")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    keys = saved(hashed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    filt = PlaceFilter.of(keys, "sha", at_least=2)
    marked = saved(filt.mark(keys, "sha", "maybe"))
    maybe = marked.where("maybe")
    found = _with_stays(maybe, saved(_stays(maybe), files_for(docs.sparkSession, filt.rows, ROWS_PER_FILE)))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    again = found.select(F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("row") == F.col("stays.row")).alias("kept"), sha)
    once = marked.where("not maybe").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"),
                                            F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return once.unionByName(again)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows that the filter calls unique are
    not shuffled; the others meet the table of repeated texts, one narrow row for each."""
    keys = saved(hashed(docs, id_col, text_col).withColumn("row", F.lit(0)))
    filt = PlaceFilter.of(keys, "sha", at_least=2)
    stays = saved(_stays(filt.mark(keys, "sha", "maybe").where("maybe")).select("g_sha", F.col("stays.id").alias("g_id")),
                  files_for(docs.sparkSession, filt.rows, ROWS_PER_FILE))
    sha, flag, g_sha, g_id = (fresh(docs, c) for c in ("doc_sha", "doc_maybe", "g_sha", "g_id"))
    marked = filt.mark(docs.withColumn(sha, _sha256(F.col(text_col).cast("string"))), sha, flag)
    stays = stays.select(F.col("g_sha").alias(g_sha), F.col("g_id").alias(g_id))
    maybe = marked.where(F.col(flag))
    last = (maybe.join(stays, F.col(sha) == F.col(g_sha)).where(F.col(id_col).cast("long").eqNullSafe(F.col(g_id)))
            .dropDuplicates([sha]))   # rows that share id and text
    names = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~F.col(flag)).select(*names).unionByName(last.select(*names))
