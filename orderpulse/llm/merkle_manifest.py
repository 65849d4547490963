"""Merkle manifest of a dataset as append logs in postorder.

Rows are leaves of one tree for each source, in id order; every run of ``RUN`` consecutive nodes becomes a
node of the next level (the last run may be shorter), and the sources' roots are the leaves of the top tree.

*Builders* take aligned groups of ``RUN ** LEVELS`` leaves, whose subtrees are whole, and append every
node when its last child is there, so a group's log is a contiguous part of the tree's postorder.  A group's
root is a leaf of the next round; a tree of n leaves takes log(n) / log(RUN ** LEVELS) rounds.

*Proofs* need no search: ``position`` gives the place of the node at (level, index) in a log from the sizes of
the subtrees finished before it.  From the top round down, a group reads the siblings on the way from each of
its leaves to its root and hands that way to the group below, which puts its own siblings in front.

A group has at most ``RUN ** LEVELS`` leaves whatever the input, so a source with a third of all rows is many groups;
joins are on (tree, group), each once, and only digests are shuffled.  One number for each round reaches the driver.

Defined results: a null field is ``-``; null ids come first; rows that share an id are ordered by their leaf,
and equal rows each take a place; a null source is a tree of its own, before all others; a row without
an id is never tampered with; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import files_for, map_rows, saved

RUN = 3
#: Levels of an aligned builder.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range that numbers its rows.
ROWS_PER_RANGE = 1_000_000
#: Leaves whose rows or logs fill a file.
LEAVES_PER_FILE = 50_000
_LOCAL_BITS = 33  # monotonically_increasing_id: the partition is in the upper 31 bits


def digest_of(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree of its own."""
    h = 0
    while RUN ** h < leaves:
        h += 1
    return h


def append_log(leaves: list[str], height: int) -> list[str]:
    """All nodes in the order of their completion."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(height + 1)]

    def complete(level: int, node: str) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < height and len(waiting[level]) == RUN:
            close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        complete(level + 1, digest_of("".join(run)))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(height):
        if waiting[level]:
            close(level)
    return log


def position(leaves: int, height: int, level: int, index: int) -> int:
    """Place in the log of the node ``index`` of ``level``: the nodes that are complete before it.

    After d leaves, d // RUN**t nodes of level t are complete.  A node that ends at leaf d comes before its
    ancestors that end there too; the nodes that hold the ragged end come last, lowest first."""
    end = (index + 1) * RUN ** level
    if end <= leaves:
        done = sum(end // RUN ** t for t in range(height + 1))
        return done - sum(end % RUN ** t == 0 for t in range(level + 1, height + 1)) - 1
    whole = sum(leaves // RUN ** t for t in range(height + 1))
    return whole + sum(leaves % RUN ** t != 0 for t in range(1, level))


def ways(log: list[str], leaves: int, height: int) -> Iterator[list[str]]:
    """For each leaf the siblings on its way up, two strings a level: those to the left and to the right."""
    above: list[list[str]] = [[]]   # of the nodes of the level above
    for level in range(height - 1, -1, -1):
        count = -(-leaves // RUN ** level)
        nodes = [log[position(leaves, height, level, i)] for i in range(count)]
        here = []
        for i in range(count):
            first = i - i % RUN
            here.append(["".join(nodes[first:i]), "".join(nodes[i + 1:first + RUN]), *above[i // RUN]])
        above = here
    yield from above


def folded(leaf: str, way: list[str]) -> str:
    for left, right in zip(way[::2], way[1::2]):
        leaf = digest_of(left + leaf + right)
    return leaf


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: each field as its byte count and value, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    part = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*part), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place in its ``tree`` by ``order``, and ``n``, the tree's rows.

    Rows are cut into ranges of (tree, order); a range adds the counts of the ranges before it.  Those counts are
    at most one row for each tree and range, and are joined on both, so no key holds more than a range."""
    keys = ["tree", *order]
    count = rows.count()
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, count // ROWS_PER_RANGE)
    parted = saved(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
                   .withColumn("mid", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("mid", _LOCAL_BITS)),
                   files_for(rows.sparkSession, count, LEAVES_PER_FILE))
    counts = parted.groupBy("tree", "pid").agg(F.count(F.lit(1)).alias("rows"), F.min("mid").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "pid", "first", before.alias("before"), F.sum("rows").over(tree).alias("n"))
    out = parted.join(starts, ["tree", "pid"])
    return out.withColumn("i", F.col("before") + F.col("mid") - F.col("first")).drop("mid", "pid", "first", "before")


def _height(n: int, leaves: int, levels: int) -> int:
    return levels if n > RUN ** levels else height_of(leaves)


def _leaves(n: int, part: int, levels: int) -> int:
    return min(RUN ** levels, n - part * RUN ** levels)


def grow(leaves: DataFrame, carried: list[str], levels: int, files: int) -> list[DataFrame]:
    """The rounds of all trees: (tree, part, n, log, ...) of every group, ``n`` being the leaves of the
    tree in that round.  The first round carries the columns ``carried`` of the leaves as arrays."""
    rounds, kinds, span = [], {"doc_id": "long"}, RUN ** levels
    while True:
        item = F.struct("i", "hash", *carried)
        parts = leaves.groupBy("tree", F.floor(F.col("i") / span).alias("part"), "n").agg(F.array_sort(F.collect_list(item)).alias("leaf"))
        parts = parts.select("tree", "part", "n", F.col("leaf.hash").alias("hashes"), *(F.col(f"leaf.{c}").alias(c) for c in carried))

        def make(carried=tuple(carried)):
            def f(b) -> dict:
                logs = [append_log(h, _height(n, len(h), levels)) for n, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                return {"tree": b.column(0), "part": b.column(1), "n": b.column(2), "log": logs, "root": [x[-1] for x in logs],
                        **{c: b.column(4 + k) for k, c in enumerate(carried)}}
            return f

        schema = "tree string, part long, n long, log array<string>, root string"
        rounds.append(saved(map_rows(parts, make, ", ".join([schema, *(f"{c} array<{kinds.get(c, 'string')}>" for c in carried)]), 16), files))
        tall = rounds[-1].where(F.col("n") > span)
        if tall.isEmpty():
            return rounds
        leaves = tall.select("tree", F.col("part").alias("i"), F.ceil(F.col("n") / span).alias("n"), F.col("root").alias("hash"))
        carried = []


def roots(rounds: list[DataFrame], levels: int) -> DataFrame:
    """(tree, root) of every tree."""
    last = [r.where(F.col("n") <= RUN ** levels).select("tree", "root") for r in rounds]
    out = last[0]
    for r in last[1:]:
        out = out.unionByName(r)
    return out


def _leaf_ways(groups: DataFrame, levels: int) -> DataFrame:
    """(tree, i, ends, way) of every leaf of ``groups`` (tree, part, n, log, ends, above)."""
    def make():
        def f(b) -> dict:
            out: dict[str, list] = {"tree": [], "i": [], "ends": [], "way": []}
            for tree, part, n, log, ends, above in zip(*(b.column(k).to_pylist() for k in range(6))):
                leaves = _leaves(n, part, levels)
                for j, way in enumerate(ways(log, leaves, _height(n, leaves, levels))):
                    out["tree"].append(tree)
                    out["i"].append(part * RUN ** levels + j)
                    out["ends"].append(ends)
                    out["way"].append(way + above)
            return out
        return f
    rows = groups.select("tree", "part", "n", "log", "ends", "above")
    return map_rows(rows, make, "tree string, i long, ends array<string>, way array<string>", 4)


def with_ways(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The groups of the first round with ``above``, the way from the group's root to the root over all, and
    ``ends``, the roots on it; both come from ``tops`` (tree, ends, above) where a tree ends."""
    below = None
    for r in reversed(rounds):
        groups = r.where(F.col("n") <= RUN ** levels).join(tops, "tree")
        if below is not None:
            inner = below.select("tree", F.col("i").alias("part"), "ends", F.col("way").alias("above"))
            groups = groups.unionByName(r.where(F.col("n") > RUN ** levels).join(inner, ["tree", "part"]))
        below = _leaf_ways(groups, levels)
    return groups


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.  The folded root
    starts from the row with the columns of ``tampered`` in place of its own, and takes the manifest's siblings."""
    changed = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))   # null first, then bytewise
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf_of([F.col(f"`{c}`") for c in FIELDS]).alias("hash"), leaf_of(changed).alias("other"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    files = files_for(docs.sparkSession, rows.count(), LEAVES_PER_FILE)
    placed = numbered(rows, ["doc_id", "hash", "row"])
    rounds = grow(placed.select("tree", "i", "n", "hash", "doc_id", "other"), ["doc_id", "other"], levels, files)

    sources = roots(rounds, levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash"))
    sources = saved(numbered(sources, ["of"]), files)
    top_rounds = grow(sources.select("tree", "i", "n", "hash"), [], levels, files)
    start = roots(top_rounds, levels).select("tree", F.array("root").alias("ends"), F.array().cast("array<string>").alias("above"))
    top_ways = _leaf_ways(with_ways(top_rounds, start, levels), levels).select("i", "ends", F.col("way").alias("above"))
    tops = sources.join(top_ways, "i").select(F.col("of").alias("tree"), F.concat(F.array("hash"), "ends").alias("ends"), "above")
    groups = with_ways(rounds, saved(tops, files), levels)

    def make():
        def f(b) -> dict:
            out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
            for part, n, log, ids, others, ends, above in zip(*(b.column(k).to_pylist() for k in range(7))):
                leaves = _leaves(n, part, levels)
                height = _height(n, leaves, levels)
                for j, way in enumerate(ways(log, leaves, height)):
                    whole = way + above
                    row = (ids[j], log[position(leaves, height, 0, j)], *ends, digest_of("".join(whole)), folded(others[j], whole))
                    for c, v in zip(out, row):
                        out[c].append(v)
            return out
        return f

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = map_rows(groups.select("part", "n", "log", "doc_id", "other", "ends", "above").coalesce(files), make, schema, 4)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> dict[str, Column]:
    """The audited copy: texts of some rows without their line ends."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {"text": F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
