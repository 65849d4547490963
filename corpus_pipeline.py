"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, byte-level BPE.

Each stage works on all documents that the one before kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the last return the columns
of documents; mixing repeats rows that the mix takes more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from orderpulse.session import ensure_checkpoint_dir
from orderpulse.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules and boilerplate lines of the others (operator 5)."""
    return quality_rules.clean(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts (operator 8)."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, five-word shingles (operator 9)."""
    return near_dedup.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights (operator 3)."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded bytes of each text (operator 1)."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
    ("mixing", mixing_stage), ("byte_bpe", encoding_stage)]

#: Near-duplicate components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; stages are written in the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}-{id(object()):x}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{base}/{i}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs.select(F.lit(None))
