"""Merkle fixity audit of two replicas of a WARC collection.

Records are laid out in archive files of ``FILE_RECORDS`` records, in order, each with its byte
offset and length.  A leaf hashes a record's offset range and its content digest; an inner node
hashes the nodes of ``FANOUT`` consecutive ranges, so it stands for one ordered offset range; a
file's root is its last node.  Two replicas are compared from the roots down: only the children of nodes
that differ are looked at on the next level, so an intact file costs one comparison.

Every group of a level has at most ``FANOUT`` rows and every file at most ``FILE_RECORDS``, whatever
the input, and the hashing and the levels are DataFrame operations.

Defined results: null urls and contents count as empty; records are ordered by id, url and digest, null
ids first, and repeated records each take a place; a record that one replica lacks is ``missing`` or
``extra``; two empty replicas give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .common import lookup, saved

FILE_RECORDS = 4096
FANOUT = 16
LEVELS = 3  # FANOUT ** LEVELS == FILE_RECORDS


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """A response record as text; its UTF-8 bytes are what is stored."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layouts(pages: DataFrame, replicas: list[Column]) -> list[DataFrame]:
    """For each of ``replicas``, the records it stores of ``pages``: (page_id, warc_file, record, offset, length, digest).  The
    place of a record follows from page_id, url and the digest of html, which replicas share, so places are given once."""
    stored = [c for i, r in enumerate(replicas) for c in (F.octet_length(r).cast("long").alias(f"length{i}"), F.sha2(r, 256).alias(f"digest{i}"))]
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("content"), *stored)
    placed = global_row_number(rows, ["page_id", "url", "content"], "place").withColumn("warc_file", F.floor((F.col("place") - 1) / FILE_RECORDS))
    placed = placed.withColumn("record", (F.col("place") - 1) % FILE_RECORDS)
    before = Window.partitionBy("warc_file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"length{i}").over(before), F.lit(0)).alias(f"offset{i}") for i in range(len(replicas))]
    laid = saved(placed.select("page_id", "warc_file", "record", *(f"{n}{i}" for i in range(len(replicas)) for n in ("length", "digest")), *offsets))
    return [laid.select("page_id", "warc_file", "record", *(F.col(f"{n}{i}").alias(n) for n in ("offset", "length", "digest"))) for i in range(len(replicas))]


def leaves(records: DataFrame) -> DataFrame:
    """(warc_file, node, hash) of records."""
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    return records.select("warc_file", F.col("record").alias("node"), leaf.alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """(warc_file, node, hash) of each inner level, lowest first.  They are written once, a row for ``FANOUT`` of the
    level below, so comparing them does not hash the leaves again."""
    levels = [leaves(records)]
    for _ in range(LEVELS):
        up = levels[-1].groupBy("warc_file", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below"))
        levels.append(saved(up.select("warc_file", F.col("up").alias("node"), F.sha2(F.concat_ws("", F.col("below.hash")), 256).alias("hash"))))
    return levels[1:]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(warc_file, node, state) of nodes that are not the same in both, written once."""
    a, b = a.withColumnRenamed("hash", "ha"), b.withColumnRenamed("hash", "hb")
    state = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    return saved(a.join(b, ["warc_file", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("warc_file", "node", state.alias("state")))


def _below(rows: DataFrame, node: str, bad: DataFrame) -> DataFrame:
    """The rows of a level that lie below the differing nodes ``bad`` of the level above."""
    suspects = lookup(bad.select("warc_file", F.col("node").alias("up")))
    return rows.withColumn("up", F.floor(F.col(node) / FANOUT)).join(suspects, ["warc_file", "up"], "left_semi").drop("up")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of either replica (page_id, warc_file, record, offset, length, digest, root, state); state is intact,
    corrupt, moved (same content at another offset), missing (from the replica) or extra (in the replica).

    The two are joined record by record only below nodes that differ; the primary's other records are passed through."""
    a, b = tree(primary), tree(replica)
    bad = _differing(a[-1], b[-1])
    for level in range(LEVELS - 2, -1, -1):
        bad = _differing(_below(a[level], "node", bad), _below(b[level], "node", bad))
    bad = _differing(leaves(_below(primary, "record", bad)), leaves(_below(replica, "record", bad)))
    place = ["warc_file", "record"]
    bad = bad.withColumnRenamed("node", "record")
    stored = replica.select(*place, *(F.col(c).alias(f"r_{c}") for c in ("page_id", "offset", "length", "digest")))
    found = saved(bad.join(stored, place, "left"))
    extra = found.where(F.col("state") == "extra").select(F.col("r_page_id").alias("page_id"), *place, *(F.col(f"r_{c}").alias(c) for c in ("offset", "length", "digest")), "state")
    same = (F.col("digest") == F.col("r_digest")) & (F.col("length") == F.col("r_length"))
    state = F.when(F.col("state").isNull(), "intact").when(same, "moved").otherwise(F.col("state"))
    known = primary.join(lookup(found.drop("r_page_id", "r_offset")), place, "left").select("page_id", *place, "offset", "length", "digest", state.alias("state"))
    roots = a[-1].select("warc_file", F.col("hash").alias("root"))
    return known.unionByName(extra).join(roots, "warc_file", "left").select("page_id", *place, "offset", "length", "digest", "root", "state")


def audit_pages(pages: DataFrame, replica_body: Column) -> DataFrame:
    """Audit the records of ``pages`` against a replica that stores ``replica_body`` as their content."""
    head = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    header = F.substring_index(head, "\r\n\r\n", 1)
    stored = F.concat(header, F.lit("\r\n\r\n"), F.coalesce(replica_body, F.lit("")), F.lit("\r\n\r\n"))
    return audit(*layouts(pages, [head, stored]))
