"""The queries of this subpackage: each dealt operator on its whole table, and the pipeline.

The queries are thin: rows come from the operators, and digest columns are derived from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import ensure_utc, to_contract
from ..sources.tables import read_table
from . import bpe, divergence, exact_dedup, fixity, langid, merkle_manifest, mixing, near_dedup, pii, quality_rules, secret_scan, suffix_dedup, token_counts
from .common import documents
from .oracles import ORACLES

#: op9 takes four words by its contract.
CONTRACT_SHINGLE = 4


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text, and back: token count and digests of ids and decoded bytes."""
    return bpe.digests(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from three quarters of the labelled documents."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: the patterns' spans and the CRF's."""
    return pii.digest(pii.find(documents(spark, sf_dir), pii.train(pii.labelled_table(spark))))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text."""
    return quality_rules.measures(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: the patterns' spans and the guess-cost method's."""
    return pii.digest(secret_scan.scan(documents(spark, sf_dir)), secret_scan.BASE_KINDS, keep=("max_guesses_log10",))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every whole text."""
    return token_counts.token_counts(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document among texts equal but for A-Z."""
    return exact_dedup.groups(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.groups(documents(spark, sf_dir), shingle=CONTRACT_SHINGLE)


def damaged() -> Column:
    """The content of the audited replica: the first character of some pages is overwritten."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return F.when((F.col("page_id") % 89 == 5) & (F.length(html) > 0), F.concat(F.lit("~"), F.substring(html, 2, 2147483647))).otherwise(html)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive of ``pages`` audited against a replica with damaged records."""
    return fixity.audit_pages(read_table(spark, sf_dir, "pages"), damaged())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that set a source apart."""
    return divergence.audit(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every row against the manifest's root, and the check of a copy with changed texts."""
    return merkle_manifest.manifest(documents(spark, sf_dir), merkle_manifest.without_newlines())


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that repeated strings of 200 bytes cover."""
    return suffix_dedup.digest(suffix_dedup.spans(documents(spark, sf_dir)))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_language_id, op3_mixing, op4_pii, op5_line_quality, op6_secrets,
                            op7_token_counts, op8_exact_dedup, op9_near_dedup, op10_warc_fixity, op11_source_divergence, op12_merkle_manifest,
                            op13_suffix_dedup)}


def _ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_utc(spark)
        return to_contract(f(spark, sf_dir))
    build.__name__, build.__doc__ = f.__name__, f.__doc__
    return build


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline of ``corpus_pipeline.py`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _ready(f) for k, f in (OPERATORS | {"pipeline": pipeline}).items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
