"""Repeated strings of ``LENGTH`` bytes, found by merging Burrows-Wheeler transforms of shards.

Every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else is removed.

1. *Anchors* decide which strings can be equal.  The anchor of the window [i, i + LENGTH) is the least hash of
   its ``GRAM``-byte grams (the rightmost of equal ones), so equal windows have equal anchors at equal offsets.
   Windows with one anchor are consecutive, about 50; a text is described by the hashes of its anchors.
2. Equal texts are one text; all bytes of a text with copies are removed, and one copy stands for them below.
   Texts with an anchor that occurs twice are read again, once each, and cut to *pieces*: an anchor with its windows.
3. Equal pieces are one piece; all windows of a piece that occurs twice repeat.  The pieces of an
   anchor that are not equal may still share windows.  An anchor with very many of them is split by its windows'
   offset and by the bytes that all windows of such a range share: ranges of 64, 32, ... 1 offsets, the
   last being whole windows, which equal pieces settle.  So no group is large, and none is cut off.
4. The pieces of a group are merged.  A shard of pieces sorts its own suffixes, one ``STEP``-byte symbol a round from
   the end of the windows to their start, and keeps the Burrows-Wheeler column of each round: the symbols before
   its sorted suffixes.  The merge knows only these columns and the *interleave*, the shard of each place
   in the joint order.  Each round deals the interleave stably by the shards' next symbols, which sorts by one more
   symbol, and a place where symbol or old block changes starts a new block: its common prefix with the place before is
   shorter.  After LENGTH / STEP rounds a block is a repeated interval, and a shard's r-th place is its r-th suffix.
   Symbols are 64-bit hashes of their bytes; bytes are compared in each block that is reported.

Texts are shuffled when they hold a repeated anchor, others are only hashed.  Keys that very many rows share meet
broadcast tables (fewer than ``MAX_HOT`` keys hold more than their share of that), equal rows are combined in the task first.

Defined results: null counts as an empty text; a text shorter than ``LENGTH`` has no match; rows with equal
texts are documents of their own, whatever their ids; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import MAX_BROADCAST_ROWS, lookup, map_rows, saved, written

LENGTH, GRAM, STEP = 200, 100, 25
#: Grams of a window, and the powers of two that cover offsets of an anchor.
OFFSETS, WIDEST = LENGTH - GRAM + 1, 128
#: Windows of a text worked on at once.
CHUNK = 1 << 20
#: Pieces of a group that are merged in one task.
MAX_PIECES = 20_000
#: Bytes of pieces merged at once, and the shards of such a block.
BLOCK_BYTES, SHARDS = 2 << 20, 4
HOT_ROWS, MAX_HOT = 1000, 10_000

_PIECE = "key long, digest binary, lead int, piece binary, ref long, start long, need boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def hashes(u: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each string of ``size`` bytes of ``u``, by differences of one running polynomial."""
    n = len(u)
    if n < size:
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[u] * _powers[0][:n], out=total[1:])
    return _mix((total[size:] - total[:-size]) * _powers[1][:n - size + 1])


_PLACE = np.uint64((1 << 21) - 1)


def anchored(u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, anchor, hash) of each run of windows with one anchor, a part of the text at a time."""
    for at in range(0, max(0, len(u) - LENGTH + 1), CHUNK):
        part = u[at:at + CHUNK + LENGTH - 1]
        grams = hashes(part, GRAM)
        low = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))   # a later place is less
        width = 1
        while 2 * width <= OFFSETS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < OFFSETS:
            low = np.minimum(low[:-(OFFSETS - width)], low[OFFSETS - width:])
        anchor = (_PLACE - (low & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        yield at + first, at + last, at + anchor[first], grams[anchor[first]].view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, sha, anchors) of every row."""
    def make():
        def f(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_bytes": [], "sha": [], "anchors": []}
            for t in b.column(1).to_pylist():
                raw = _bytes(t)
                out["n_bytes"].append(len(raw))
                out["sha"].append(sha256(raw).digest())
                runs = [x[3] for x in anchored(np.frombuffer(raw, np.uint8))]
                out["anchors"].append(np.concatenate(runs) if runs else np.zeros(0, np.int64))
            return out | {"id": b.column(0)}
        return f

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, make, "id long, n_bytes long, sha binary, anchors array<long>", 200)


def _hot(often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``often`` (key, n) that have very many partners, fewer than ``MAX_HOT``, and the others."""
    total = often.agg(F.sum("n")).first()[0] or 0
    many = max(HOT_ROWS, total // MAX_HOT)
    return often.where(F.col("n") > many), often.where(F.col("n") <= many)


def _that_occur_in(rows: DataFrame, often: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``often`` (key, n); rows of a key with very many are not shuffled."""
    hot, few = (x.select(key) for x in _hot(often))
    some = rows.join(F.broadcast(hot), key, "left_semi")
    return some.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(few.hint("merge"), key, "left_semi"))


def pieces(texts: DataFrame) -> DataFrame:
    """The pieces of the wanted anchors of ``texts`` (row, n, wanted, text): an anchor's windows with the
    bytes that they cover, ``lead`` bytes of them before the anchor."""
    def make():
        def f(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in _PIECE.split(", ")}
            for row, n, wanted, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = _bytes(text)
                for first, last, anchor, h in anchored(np.frombuffer(raw, np.uint8)):
                    hit = np.isin(h, np.array(wanted, np.int64))
                    for i, j, a, key in zip(first[hit].tolist(), last[hit].tolist(), anchor[hit].tolist(), h[hit].tolist()):
                        _put(out, key, a - i, raw[i:j + LENGTH], row, i, n == 1)
            return out
        return f

    return map_rows(texts.select("row", "n", "wanted", "text"), make, _PIECE, 100)


def _put(out: dict[str, list], key: int, lead: int, piece: bytes, ref: int, start: int, need: bool) -> None:
    digest = blake2b(piece, digest_size=16, salt=lead.to_bytes(2, "big")).digest()
    for c, v in zip(out, (key, digest, lead, piece, ref, start, need)):
        out[c].append(v)


def split(rows: DataFrame, width: int) -> DataFrame:
    """Pieces cut by their windows' offset to the anchor, in ranges of ``width``; the key of a range is the
    hash of the bytes that all its windows share."""
    def make():
        def f(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in _PIECE.split(", ")}
            for lead, piece, ref, start, need in zip(*(b.column(i).to_pylist() for i in range(5))):
                least = lead - (len(piece) - LENGTH)
                for cell in range(least // width, lead // width + 1):
                    low, high = cell * width, min(cell * width + width, OFFSETS) - 1
                    shared = piece[lead - low:lead - high + LENGTH]   # of a window at offset d: [lead - d, lead - d + LENGTH)
                    key = int.from_bytes(blake2b(shared, digest_size=8, salt=cell.to_bytes(2, "big")).digest(), "big", signed=True)
                    d0, d1 = max(low, least), min(high, lead)
                    skip = lead - d1
                    _put(out, key, d1, piece[skip:lead - d0 + LENGTH], ref, start + skip, need)
            return out
        return f

    return map_rows(rows.select("lead", "piece", "ref", "start", "need"), make, _PIECE, 100)


def merged(blocks: list[list[bytes]]) -> list[np.ndarray]:
    """For each piece of each shard of ``blocks``, whether its windows occur elsewhere among them."""
    all_pieces = [p for shard in blocks for p in shard]
    size = np.array([len(p) for p in all_pieces])
    base = np.cumsum(size) - size
    count = size - LENGTH + 1
    u = np.frombuffer(b"".join(all_pieces), np.uint8)
    symbol = hashes(u, STEP)
    windows = np.repeat(base - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    of_shard = np.repeat([s for s, shard in enumerate(blocks) for _ in shard], count)
    rounds = range(LENGTH - STEP, -1, -STEP)   # offsets of the symbols, the last one first

    columns: list[list[np.ndarray]] = []   # of each shard: the symbols before its suffixes, round by round
    orders = []
    for s in range(len(blocks)):
        order, own = np.flatnonzero(of_shard == s), []
        for offset in rounds:
            before = symbol[windows[order] + offset]
            own.append(before)
            order = order[np.argsort(before, kind="stable")]
        columns.append(own)
        orders.append(order)

    interleave = of_shard.copy()
    block = np.zeros(len(windows), np.int64)
    for r in range(len(rounds)):
        before = np.empty(len(windows), np.uint64)
        before[np.argsort(interleave, kind="stable")] = np.concatenate([c[r] for c in columns])
        deal = np.argsort(before, kind="stable")
        interleave, before, block = interleave[deal], before[deal], block[deal]
        block = np.cumsum(np.append(False, (before[1:] != before[:-1]) | (block[1:] != block[:-1])))
    suffix = np.empty(len(windows), np.int64)
    suffix[np.argsort(interleave, kind="stable")] = np.concatenate(orders)
    again = _verified(u, windows[suffix], block)
    out = np.zeros(len(windows), bool)
    out[suffix] = again
    return np.split(out, np.cumsum(count)[:-1])


def _verified(u: np.ndarray, start: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether each place's window equals another of its block; bytes decide where hashes took two for one."""
    same = block[1:] == block[:-1]
    again = np.append(False, same) | np.append(same, False)
    view = np.lib.stride_tricks.sliding_window_view(u, LENGTH) if len(u) >= LENGTH else np.zeros((0, LENGTH), np.uint8)
    at = np.flatnonzero(same)
    for i in range(0, len(at), 20_000):
        j = at[i:i + 20_000]
        if not np.array_equal(view[start[j]], view[start[j + 1]]):
            k = np.flatnonzero(again)
            _, which, n = np.unique(view[start[k]], axis=0, return_inverse=True, return_counts=True)
            again[k] = n[which.ravel()] > 1
            break
    return again


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist())


def repeats(groups: DataFrame) -> DataFrame:
    """(ref, start, count): windows of needed pieces that occur in another piece of their key.  A task takes whole
    keys in order and merges about ``BLOCK_BYTES`` of pieces at a time."""
    rows = groups.select("key", "piece", "ref", "start", "need")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    schema = pa.schema([("ref", pa.int64()), ("start", pa.int64()), ("count", pa.int64())])
    ship_package(rows.sparkSession)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        # a piece that has its key for itself has nothing to share
        held = [x for i, x in enumerate(held) if (i and held[i - 1][0] == x[0]) or (i + 1 < len(held) and held[i + 1][0] == x[0])]
        step = -(-len(held) // SHARDS)
        shards = [[x[1] for x in held[i:i + step]] for i in range(0, len(held), max(1, step))]
        found = [(ref, start + i, j - i) for (_, _, ref, start, need), flags in zip(held, merged(shards) if held else []) if need for i, j in _runs(flags)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "ref long, start long, count long")


def found_windows(rows: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """(ref, start, count) of all runs of repeated windows of needed pieces."""
    out, width = [], WIDEST
    while True:
        one = F.first(F.struct("lead", "piece", "ref", "start", "need")).alias("one")
        distinct = written(rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), one).select("key", "digest", "n", "one.*"))
        twice = distinct.where("n > 1").select("digest", "n")
        twice = twice.groupBy("digest").agg(F.sum("n").alias("n"))
        mine = rows.where("need").select("digest", "ref", "start", (F.octet_length("piece") - LENGTH + 1).cast("long").alias("count"))
        out.append(_that_occur_in(mine, saved(twice), "digest").select("ref", "start", "count"))
        alone = distinct.withColumn("need", F.col("need") & (F.col("n") == 1))
        keys = saved(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"))
        hot = lookup(keys.where(F.col("pieces") > max_pieces).select("key"))
        if hot.isEmpty():
            out.append(repeats(alone))
            break
        out.append(repeats(alone.join(hot, "key", "left_anti")))
        width //= 2
        rows = written(split(alone.join(hot, "key", "left_semi"), width))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def cut(raw: bytes, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The removed spans (start, end) that the windows ``runs`` (start, count) cover, and the bytes left."""
    spans: list[list[int]] = []
    for start, count in sorted(runs):
        end = start + count - 1 + LENGTH
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return [(s, e) for s, e in spans], b"".join([*kept, raw[at:]])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed run) and kept_sha256 of every row."""
    keys = written(described(docs, id_col, text_col))
    texts = keys.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"))
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()))   # a short name of the text from here on
    copies = texts.where("n > 1").select("sha", "n")
    grams = texts.select("row", F.explode("anchors").alias("key"))
    often = saved(grams.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = _that_occur_in(grams, often, "key").groupBy("row").agg(F.collect_set("key").alias("wanted"))
    wanted = saved(texts.select("row", "sha", "n").join(wanted, "row"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text")).where(F.octet_length("text") >= LENGTH)
    if wanted.count() <= MAX_BROADCAST_ROWS:
        raw = raw.join(F.broadcast(wanted.select("sha")), "sha", "left_semi")
    raw = written(raw.groupBy("sha").agg(F.first("text").alias("text")).join(wanted, "sha"))
    windows = found_windows(written(pieces(raw)), max_pieces)
    runs = saved(windows.groupBy(F.col("ref").alias("row")).agg(F.collect_list(F.struct("start", "count")).alias("runs")))

    def make():
        def f(b: pa.RecordBatch) -> dict:
            done = [cut(_bytes(t), [(r["start"], r["count"]) for r in runs]) for t, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            return {"sha": b.column(0), "spans": [[{"start": s, "end": e} for s, e in x] for x, _ in done],
                    "kept_sha256": [sha256(kept).hexdigest() for _, kept in done]}
        return f

    few = raw.select("row", "sha", "text").join(runs, "row").select("sha", "text", "runs")
    some = map_rows(few, make, "sha binary, spans array<struct<start:long,end:long>>, kept_sha256 string", 100)
    hot, rest = (x.select("sha", F.lit(True).alias("copy")) for x in _hot(copies))
    some = saved(some.select("sha", "spans", "kept_sha256", F.lit(False).alias("copy")).unionByName(rest, allowMissingColumns=True))
    known = keys.select("id", "n_bytes", "sha")
    of_hot = known.join(F.broadcast(hot), "sha").select("*", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(None).cast("string").alias("kept_sha256"))
    others = known.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(some.hint("merge"), "sha", "left")
    every = of_hot.unionByName(others)
    copy = F.coalesce("copy", F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return every.select(F.col("id").alias("doc_id"), "n_bytes", F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
                        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``spans``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
