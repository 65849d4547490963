"""Near-duplicate groups: MinHash with banding, signature check, exact check, connected components.

1. A text's set is its distinct word shingles as 64-bit hashes.  Texts with equal sets are one class;
   only a class's smallest id goes on, so any number of copies costs one row.
2. ``BANDS`` x ``ROWS`` universal hash minima (multiply-shift) give a signature; the minima of a band
   are hashed to a bucket key.  With 32 bands of 5, a pair at similarity 0.8 shares no bucket
   with probability 3e-6.
3. In a bucket every member is paired with the bucket's smallest id, so a bucket makes as many
   pairs as it has members, whatever its size.  A pair stays a candidate when its signatures agree
   to within five standard deviations of the threshold.
4. Each document's best candidate is confirmed on full sets, and the links give first components.
   Where a bucket still holds several, all its signatures are compared, block against block, which
   joins components to clusters; in a cluster the documents outside the largest component are
   compared on full sets with all documents of other components.  So no link between documents
   that share a bucket and agree is lost, while copies of one text never meet in pairs.
5. Components: alternating large-star and small-star over the confirmed links.

Only bucket keys, signatures and the texts of candidates are shuffled; a Bloom filter of candidate
ids keeps other texts out of the shuffle.  Nothing but row counts and checksums reaches the driver.

Defined results: a null text or one without words has the empty set, is linked with nothing and is
kept; a row without an id cannot be named, so it is linked with nothing and kept; rows that share
an id are one document; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import PlaceFilter, hash_of
from .common import MAX_BROADCAST_ROWS, files_for, fresh, lookup, lower_ascii, map_rows, saved

SHINGLE = 5
THRESHOLD_PERCENT = 80
BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Documents of a block, for comparing signatures in a bucket and full sets in a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 128
#: Blocks of a side of the square of block pairs that is dealt to a task.
STRIP = 4
#: Five standard deviations of a signature's agreement at the threshold.
LEAST_AGREEMENT = 0.8 - 5 * (0.8 * 0.2 / MINIMA) ** 0.5
#: Bytes of text hashed at once; a longer text is hashed in parts that end at white space.
CHUNK = 1 << 22
#: Documents whose rows fill a file of a saved table.
DOCS_PER_FILE = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _randoms(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _randoms(256, 11)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_FACTOR = _randoms(64, 12) | np.uint64(1)
_A = _randoms(MINIMA, 13) | np.uint64(1)
_B = _randoms(MINIMA, 14)
_BAND = (_randoms(MINIMA, 15) | np.uint64(1)).reshape(BANDS, ROWS)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _hash_words(raw: bytes) -> np.ndarray:
    """64-bit hash of each word, in order."""
    u = np.frombuffer(raw, np.uint8)
    solid = ~((u == 32) | ((u >= 9) & (u <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(u))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[u] * power)))
    return _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    if len(raw) <= CHUNK:
        return _hash_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not (raw[end] == 32 or 9 <= raw[end] <= 13):
            end += 1
        out.append(_hash_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    w = word_hashes(lower_ascii(text)) if text else np.zeros(0, np.uint64)
    n = len(w)
    if n < size:
        return _mix(np.sum(w * _WORD_FACTOR[:n], keepdims=True) + np.uint64(n)) if n else w
    s = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        s += w[j:n - size + 1 + j] * _WORD_FACTOR[j]
    return np.unique(_mix(s))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: the minimum of each hash over the set, upper 32 bits."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(low, (_A[:, None] * shingles[None, at:at + 256] + _B[:, None]).min(1), out=low)
    return low >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    return _mix((rows * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = THRESHOLD_PERCENT) -> bool:
    small = min(len(a), len(b))
    if not small or 100 * small < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, class, bands, signature); the last three are null for the empty set."""
    def make():
        def f(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_shingles": [], "class": [], "bands": [], "signature": []}
            for t in b.column(1).to_pylist():
                s = shingle_set(t, shingle)
                out["n_shingles"].append(len(s))
                low = minima(s) if len(s) else None
                out["class"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["bands"].append(band_keys(low) if len(s) else None)
                out["signature"].append((low & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else None)
            return out | {"id": b.column(0)}
        return f

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, make, "id long, n_shingles long, class binary, bands array<long>, signature binary")


def agreement(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, like) of the pairs whose signatures agree well enough; ``like`` is the share of equal minima."""
    s = signed.select("id", "signature")
    a = s.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    b = s.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "sa", "sb")

    def make():
        def f(x: pa.RecordBatch) -> dict:
            p, q = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA) for i in (2, 3))
            like = (p == q).mean(1)
            keep = like >= LEAST_AGREEMENT
            return {"a": x.column(0).filter(pa.array(keep)), "b": x.column(1).filter(pa.array(keep)), "like": like[keep]}
        return f

    return map_rows(both, make, "a long, b long, like double")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows of ``docs`` whose id is in ``ids`` (and few others), one for each id."""
    wanted = PlaceFilter.of(ids.withColumn("digest", hash_of(F.col("id"))), "digest")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    texts = wanted.mark(texts.withColumn("digest", hash_of(F.col("id"))), "digest", "maybe").where("maybe").select("id", "text")
    return texts.groupBy("id").agg(F.max("text").alias("text"))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, id_col, text_col)
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")

    def make():
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def set_of(i: int, text: str) -> np.ndarray:
            if i not in known:
                known[i] = shingle_set(text, shingle)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[i]

        def f(x: pa.RecordBatch) -> dict:
            rows = zip(*(x.column(i).to_pylist() for i in range(4)))
            ok = [(i, j) for i, j, p, q in rows if similar(set_of(i, p), set_of(j, q))]
            return {"a": [i for i, _ in ok], "b": [j for _, j in ok]}
        return f

    return map_rows(both, make, "a long, b long")


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): the smallest id it is connected with."""
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    while not _is_stars(edges):
        few = edges.count() <= MAX_BROADCAST_ROWS
        hint = F.broadcast if few else lambda x: x
        # large-star: every larger neighbour of u is linked to u's smallest neighbour (or u)
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(hint(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        # small-star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        down = large.join(hint(low), "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = saved(down.union(low.select("u", F.col("low").alias("v"))).distinct(), files)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour or only larger ones."""
    two = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b")
    return two.isEmpty() and edges.join(lookup(edges.select(F.col("u").alias("w"))), F.col("v") == F.col("w"), "left_semi").isEmpty()


def _rooted(rows: DataFrame, names: list[str], roots: DataFrame) -> DataFrame:
    """``rows`` with ``root_<name>`` of each id column; an id that ``roots`` does not list is its own root."""
    roots = lookup(roots)
    for c in names:
        r = roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root"))
        rows = rows.join(r, rows[c] == F.col("r_id"), "left").withColumn(f"root_{c}", F.coalesce("r_root", F.col(c))).drop("r_id", "r_root")
    return rows


def _grown(roots: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """``roots`` after more ``links``: components of the roots, then composed."""
    more = _rooted(links, ["a", "b"], roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a != b")
    higher = saved(components(more, files), files)
    old = _rooted(roots, ["root"], higher).select("id", F.col("root_root").alias("root"))
    new = higher.join(lookup(roots.select("id")), "id", "left_anti")
    return saved(old.unionByName(new), files)


def _blocks(rows: DataFrame, group: str, size: int, value: Column, files: int | None) -> DataFrame:
    """(group, block, n, items): the rows of each group in ``n`` blocks of about ``size`` by a hash of the id."""
    counts = lookup(saved(rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n")), files))
    dealt = rows.join(counts, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    return dealt.groupBy(group, "block", "n").agg(F.collect_list(value).alias("items"))


def _block_pairs(blocks: DataFrame, other: DataFrame, group: str, once: bool = False) -> DataFrame:
    """(items, items2): each block of ``blocks`` (group, block, n2, items) with each of ``other`` (group,
    block2, n, items2) in its group, ``n`` and ``n2`` being the numbers of blocks on either side; ``once``
    takes a pair of blocks of the same table in one order only.

    The pairs of a group are cut into squares of ``STRIP`` x ``STRIP`` blocks.  A block is sent to each
    square of its row or column, and squares are dealt by (group, row, column), so the pairs of one
    group spread over all tasks."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strip = lambda x: F.floor(F.col(x) / STRIP).cast("int")
    last = lambda n: F.floor((F.col(n) - 1) / STRIP).cast("int")
    a = blocks.select(group, "block", strip("block").alias("row"), F.explode(F.sequence(strip("block") if once else F.lit(0), last("n2"))).alias("column"), "items")
    b = other.select(group, "block2", F.explode(F.sequence(F.lit(0), strip("block2") if once else last("n"))).alias("row"), strip("block2").alias("column"), "items2")
    square = [group, "row", "column"]
    # a given number of partitions, as few bytes make much work here and must not be coalesced
    both = a.repartition(parts, *square).join(b.repartition(parts, *square), square)
    return (both.where("block <= block2") if once else both).select("items", "items2")


def _bridges(shared: DataFrame, roots: DataFrame, signed: DataFrame, files: int) -> DataFrame:
    """(a, b): pairs of roots joined by documents that share a bucket and whose signatures agree.

    Every pair of members of a bucket with several components is looked at, block against block;
    a pair of blocks gives a spanning forest of what it finds, so its result is as small as itself."""
    m = _rooted(shared.select("key", "id"), ["id"], roots).select("key", "id", F.col("root_id").alias("root"))
    mixed = m.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    m = m.join(mixed, "key").join(signed, "id").select("key", "id", "root", "signature")
    blocks = saved(_blocks(m, "key", BUCKET_BLOCK, F.struct("root", "signature"), files), files)
    other = blocks.select("key", F.col("block").alias("block2"), "n", F.col("items").alias("items2"))
    both = _block_pairs(blocks.withColumnRenamed("n", "n2"), other, "key", once=True)

    def make():
        def f(x: pa.RecordBatch) -> dict:
            edges: set[tuple[int, int]] = set()
            for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                (rp, sp), (rq, sq) = ((np.array([i["root"] for i in z]), np.frombuffer(b"".join(i["signature"] for i in z), np.uint8).reshape(-1, MINIMA)) for z in (p, q))
                top: dict[int, int] = {}

                def find(r: int) -> int:
                    while top.setdefault(r, r) != r:
                        top[r] = r = top[top[r]]
                    return r

                for r, sig in zip(rp.tolist(), sp):
                    for o in np.unique(rq[(sq == sig).mean(1) >= LEAST_AGREEMENT]).tolist():
                        if (a := find(r)) != (b := find(o)):
                            top[max(a, b)] = min(a, b)
                            edges.add((min(r, o), max(r, o)))
            return {"a": [a for a, _ in edges], "b": [b for _, b in edges]}
        return f

    return map_rows(both, make, "a long, b long", 64).distinct()


def _between(bridges: DataFrame, stand: DataFrame, roots: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str, files: int | None = None) -> DataFrame:
    """(a, b): confirmed links between components that ``bridges`` join to a cluster.

    In a cluster the documents outside its largest component are compared on full sets with all
    documents of other components, block against block; only links leave the task."""
    clusters = saved(components(bridges, files), files)
    clusters = lookup(saved(clusters.union(clusters.select("root", "root")).distinct().select(F.col("id").alias("c_root"), F.col("root").alias("cluster")), files))
    m = _rooted(stand, ["id"], roots).select("id", F.col("root_id").alias("root"))
    m = saved(m.join(clusters, m["root"] == F.col("c_root")).select("id", "root", "cluster"), files)
    sizes = m.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("most"))
    main = lookup(saved(sizes.select("cluster", F.col("most.root").alias("main")), files))
    whole = saved(m.join(texts_of(m.select("id"), docs, id_col, text_col), "id").join(main, "cluster"), files)
    item = F.struct("id", "root", "text")
    blocks = saved(_blocks(whole, "cluster", CLUSTER_BLOCK, item, files), files)
    asked = _blocks(whole.where("root != main"), "cluster", CLUSTER_BLOCK, item, files)
    asked = saved(asked.select("cluster", F.col("block").alias("block2"), F.col("n").alias("n2"), F.col("items").alias("items2")), files)
    many, few = (lookup(saved(x.select("cluster", n).distinct(), files)) for x, n in ((blocks, "n"), (asked, "n2")))
    both = _block_pairs(blocks.drop("n").join(few, "cluster"), asked.drop("n2").join(many, "cluster"), "cluster")

    def make():
        def f(x: pa.RecordBatch) -> dict:
            found: list[tuple[int, int]] = []
            for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                sets = [shingle_set(i["text"], shingle) for i in p]
                sizes = np.array([len(z) for z in sets])
                owner, values = np.repeat(np.arange(len(p)), sizes), np.concatenate(sets)
                order = np.argsort(values, kind="stable")
                owner, values = owner[order], values[order]
                root = np.array([i["root"] for i in p])
                for i in q:
                    own = shingle_set(i["text"], shingle)
                    low, high = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
                    n = high - low
                    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    both = np.bincount(owner[at], minlength=len(p))
                    linked = (100 * both >= THRESHOLD_PERCENT * (sizes + len(own) - both)) & (root != i["root"]) & (both > 0)
                    found += [(p[j]["id"], i["id"]) for j in np.flatnonzero(linked)]
            return {"a": [a for a, _ in found], "b": [b for _, b in found]}
        return f

    return map_rows(both, make, "a long, b long", 16)


def groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _groups(docs, shingle, id_col, text_col)[0]


def _groups(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``groups`` and the files for a table of its rows."""
    signed = saved(signatures(docs, shingle, id_col, text_col))
    files = files_for(docs.sparkSession, signed.count(), DOCS_PER_FILE)
    usable = signed.where("n_shingles > 0 and id is not null")
    classes = saved(usable.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "rep"), files)
    copies = saved(usable.select("id", "class").join(lookup(classes), "class").where("id != rep").select("id", "rep").distinct(), files)
    stand = usable.join(lookup(copies.select("id")), "id", "left_anti").select("id", "bands", "signature")
    keyed = stand.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub != most").select("key", "hub")
    shared = saved(keyed.join(hubs, "key"), files)
    signed_few = saved(stand.select("id", "signature").join(shared.select("id").distinct(), "id"), files)
    pairs = shared.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    likely = saved(agreement(pairs, signed_few), files)
    best = saved(likely.groupBy("b").agg(F.max(F.struct("like", (-F.col("a")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), "b"), files)
    roots = saved(components(saved(confirmed(best, docs, shingle, id_col, text_col)).union(copies.select("id", "rep")), files), files)
    bridges = saved(_bridges(shared, roots, signed_few, files), files)
    if not bridges.isEmpty():
        roots = _grown(roots, saved(_between(bridges, stand.select("id"), roots, docs, shingle, id_col, text_col, files)), files)
    found = roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root"))
    out = signed.select(F.col("id").alias("doc_id"), "n_shingles").join(lookup(found), F.col("doc_id") == F.col("r_id"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("r_root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), files


def dedup(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  A Bloom filter of the dropped ids lets
    all certainly kept rows pass without a shuffle."""
    found, files = _groups(docs, shingle, id_col, text_col)
    gone = saved(found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
                 .withColumn("digest", hash_of(F.col("gone_id"))), files)
    filt = PlaceFilter.of(gone, "digest")
    digest, flag, gone_id = fresh(docs, "id_digest"), fresh(docs, "id_maybe"), fresh(docs, "gone_id")
    marked = filt.mark(docs.withColumn(digest, hash_of(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))), digest, flag)
    names = [F.col(f"`{c}`") for c in docs.columns]
    maybe = marked.where(F.col(flag))
    rest = maybe.join(gone.select(F.col("gone_id").alias(gone_id)), F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
    return marked.where(~F.col(flag)).select(*names).unionByName(rest.select(*names))
