"""Queries of the corpus operators for the driver, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, jaccard, mixing, packing, quality, suffix_dedup, tokens, url_filter, warc
from .common import read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica with drilled damage against the records of all pages."""
    kept = warc.records(read_table(spark, sf_dir, "pages"))
    return warc.audit(warc.manifest(kept), warc.manifest(warc.rot(kept)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": jaccard.ORACLE, "op2_url_filters": url_filter.ORACLE, "op3_mixing": mixing.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op6_suffix_array_dedup": suffix_dedup.ORACLE, "op7_warc_fixity": warc.ORACLE}
