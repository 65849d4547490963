"""Mixing sources to target weights, in DataFrame operations only.

1. One narrow row per document (id, source, size, random key) is written once; the key is an MD5 of
   the id, so reruns agree and the order inside a source is random.
2. Targets: each source's share of all words by weight, stopped at ``max_epochs`` times its size; the
   excess is shared out again until no target is above its stop.  Each round is one aggregate
   over the table of sources, and only its sums come to the driver.
3. Cut: rows of a source are split by equal ranges of the (uniform) key, which spreads a source of any
   size over many tasks.  Range sums give each range's offset, a window inside the range gives each
   row's prefix sum, and the row is taken as often as the budget covers it.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, after all
others; a table without words has targets of 0; repeated rows share a place in the order by their
text's digest and each takes its own part.  The document at the cut is taken up to the
budget's last word, so a source's taken words are its target rounded to a whole word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .common import SPACE_CLASS, fresh, saved, words_of

#: Weights by position of the source, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows that a key range of the largest source holds on average, and hex digits of the key's range.
ROWS_PER_RANGE = 20_000
_RANGE_DIGITS = 8
MAX_BROADCAST_SOURCES = 100_000


def key_of(doc_id: Column, text_md5: Column) -> Column:
    """The random place of a row in its source."""
    return F.md5(F.coalesce(doc_id.cast("string"), text_md5).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` for every row of (source, source_size); sources weigh ``weights`` by code point, null last."""
    ranked = global_row_number(sizes.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = saved(ranked.select("source", "source_size", weight.cast("long").alias("weight"),
                            (F.lit(max_epochs) * F.col("source_size")).alias("stop")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rest, width, capped = total, s.agg(F.sum("weight")).first()[0] or 1, 0
    while True:   # a round stops at least one more source, or is the last
        above = F.col("stop") * F.lit(width) < F.lit(rest) * F.col("weight")
        r = s.agg(F.sum(F.when(above, F.col("stop")).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("width"),
                  F.sum(above.cast("long")).alias("n")).first()
        if not r.n or r.n == capped or not r.width:
            break
        rest, width, capped = total - r.held, r.width, r.n
    open_target = F.lit(rest).cast("double") * F.col("weight") / F.lit(width)
    return s.select("source", "source_size", F.least(F.col("stop").cast("double"), open_target).alias("target"))


def plan(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
         max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, text_md5, size, source, source_size, target, taken for every row of documents."""
    size = F.size(words_of(F.col("text"))) if size is None else size
    rows = saved(docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), size.cast("long").alias("size"))
                 .withColumn("key", key_of(F.col("doc_id"), F.col("text_md5"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = saved(targets(sizes.select("source", "source_size"), weights, max_epochs))
    n_ranges = max(1, -(-(sizes.agg(F.max("n")).first()[0] or 0) // ROWS_PER_RANGE))
    bits = F.conv(F.substring("key", 1, _RANGE_DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("part", F.floor(bits * n_ranges / F.lit(16 ** _RANGE_DIGITS)).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    sums = sums.join(goal, sums["source"].eqNullSafe(goal["source"])).select(sums["source"], "part", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r, o = local.alias("r"), sums.alias("o")
    both = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.part") == F.col("o.part")))
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size") - F.col("offset") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return both.select("r.doc_id", "text_md5", "size", F.col("r.source").alias("source"), "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of ``docs`` whole, as often as its taken words need (so a
    source exceeds its budget by less than one document); columns as in ``docs``.

    A row's number of copies follows from its key and two values of its source, the full rounds and
    the key at the cut, so the texts are not shuffled: the table of sources is broadcast up to
    ``MAX_BROADCAST_SOURCES`` rows and joined by a shuffle beyond."""
    p = plan(docs, **kw)
    rounds = F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))
    more = F.col("taken") > rounds * F.col("size")   # the part of one more round that the budget covers
    by_source = saved(p.where("source_size > 0").groupBy(F.col("source").alias("mix_source"))
                      .agg(F.max(rounds).cast("int").alias("mix_rounds"),
                           F.max(F.when(more, key_of(F.col("doc_id"), F.col("text_md5")))).alias("mix_cut")))
    if by_source.count() <= MAX_BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    names = {c: fresh(docs, c) for c in by_source.columns}
    by_source = by_source.select(*[F.col(a).alias(b) for a, b in names.items()])
    text = F.coalesce("text", F.lit(""))
    early = F.coalesce(key_of(F.col("doc_id"), F.md5(text.cast("binary"))) <= F.col(names["mix_cut"]), F.lit(False))
    times = F.when(~text.rlike(f"[^{SPACE_CLASS}]"), 0).when(early, F.col(names["mix_rounds"]) + 1).otherwise(F.col(names["mix_rounds"]))
    copy = fresh(docs, "mix_copy")
    both = docs.join(by_source, docs["source"].eqNullSafe(by_source[names["mix_source"]]))
    return (both.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
