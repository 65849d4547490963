"""Bloom filters as tables of bit blocks, for filtering rows before a shuffle.

A hash (16 bytes or more) marks ``HASHES`` places of a table with ``PLACES_PER_ROW`` places for
each row.  The table is kept as blocks of 32,768 places (4 KB), and only blocks with a marked place
exist.  It is broadcast while it has at most ``MAX_BROADCAST_BLOCKS`` blocks (64 MB); beyond that
rows meet their blocks by a join, with the same result.  Marks are counted by partial aggregates,
so a hash that a third of all rows share costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import files_for, fresh, saved

HASHES = 2
PLACES_PER_ROW = 16
MAX_BROADCAST_BLOCKS = 16_384
#: Places and blocks of a block table's file (4 MB).
PLACES_PER_BLOCK, BLOCKS_PER_FILE = 32_768, 1024


def hash_of(value: Column) -> Column:
    return F.unhex(F.md5(value.cast("string").cast("binary")))


def _places(digest: Column, n_places: int) -> list[Column]:
    """Places of a hash in the table, from separate 60-bit parts of it."""
    part = lambda i: F.conv(F.substring(F.hex(digest), 16 * i + 1, 15), 16, 10).cast("long")
    return [F.pmod(part(i), F.lit(n_places)) for i in range(HASHES)]


def _is_set(bits: Column, place: Column) -> Column:
    at = F.bitmap_bit_position(place + 1)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


@dataclass
class PlaceFilter:
    """The filter over the hashes of one table."""

    blocks: DataFrame
    n_places: int
    small: bool
    rows: int

    @staticmethod
    def of(rows: DataFrame, digest: str, at_least: int = 1) -> PlaceFilter:
        """Filter of the places that ``at_least`` rows mark."""
        n_rows = rows.count()
        n_places = max(1, n_rows * PLACES_PER_ROW)
        files = files_for(rows.sparkSession, n_places // PLACES_PER_BLOCK + 1, BLOCKS_PER_FILE)
        marks = rows.select(F.explode(F.array_distinct(F.array(*_places(F.col(digest), n_places)))).alias("place"))
        often = marks.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
        place = F.col("place") + 1   # the bitmap functions count from one
        blocks = saved(often.groupBy(F.bitmap_bucket_number(place).alias("block"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")), files)
        return PlaceFilter(blocks, n_places, blocks.count() <= MAX_BROADCAST_BLOCKS, n_rows)

    def mark(self, rows: DataFrame, digest: str, flag: str) -> DataFrame:
        """``rows`` with ``flag``: False only where the hash is certainly not in the filter."""
        out = rows.withColumn(flag, F.lit(True))
        for i, place in enumerate(_places(F.col(digest), self.n_places)):
            block, bits = fresh(rows, f"block{i}"), fresh(rows, f"bits{i}")
            one = self.blocks.select(F.col("block").alias(block), F.col("bits").alias(bits))
            out = out.join(F.broadcast(one) if self.small else one, F.bitmap_bucket_number(place + 1) == F.col(block), "left")
            out = out.withColumn(flag, F.col(flag) & _is_set(F.col(bits), place)).drop(block, bits)
        return out
