"""The corpus pipeline: quality rules, exact dedup, near-copy join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. What a stage returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import exact_dedup, jaccard, mixing, packing, quality
from linkforge.llm.common import Stages, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that break the base rules or lost too much go."""
    kept = quality.clean(docs).where("kept")
    return kept.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def best_fit_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", target_weights), ("best-fit packing", best_fit_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``. A stage's table goes when the next one is written; packing reads its
    texts before it returns."""
    stages = Stages(spark)
    docs = read_table(spark, sf_dir, "documents")
    held = None
    for _, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir))
        if held is not None:
            stages.free(held)
        held = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    stages.free(held)
    return out


ORACLE_SQL = None
"""Line rules and packing have no SQL form; a test holds run() against a plain single-process version."""
