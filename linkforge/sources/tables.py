"""Reading and writing: TSV, Parquet, JSON, models and the set-valued output files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, no quoting, nulls as empty strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", nullValue=None).na.fill("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(spark, path, ["entity_id", "business_name", "business_address", "country"])
    return raw.withColumnsRenamed({"entity_id": "id", "business_name": "raw_name", "business_address": "raw_addr"})


def explode_pairs(truth: DataFrame, query: str, targets: str) -> DataFrame:
    """(q, t) from a comma list; empty entries vanish."""
    return truth.select(F.col(query).alias("q"), F.explode(F.split(targets, ",")).alias("t")).where("t <> ''")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return explode_pairs(read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"]), "source1_entity_id", "matched_entity_ids")


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Parquet; the columns and the condition reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def target_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the noisy sources whose id is in ``ids`` (id)."""
    return records.where("src <> '1'").select("id", "core", "addr", "nums").join(ids, "id", "left_semi")


def set_rows(pairs: DataFrame, every: DataFrame, name: str, score: str | None = None) -> DataFrame:
    """One row for each id of ``every`` (id): its distinct targets as a comma list, best first; else empty."""
    order = F.struct((-F.col(score) if score else F.lit(0)).alias("o"), "t")
    once = pairs.groupBy("q", "t").agg(F.min(order).alias("x"))
    lists = once.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias(name))
    return every.join(lists, F.col("id") == F.col("q"), "left").select(F.col("id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def write_outputs(candidates: DataFrame, matches: DataFrame, every: DataFrame, out: str) -> None:
    write_tsv(set_rows(candidates, every, "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
    write_tsv(set_rows(matches, every, "matched_entity_ids"), f"{out}/matching_results.tsv")


def write_json(spark: SparkSession, value, path: str) -> None:
    """One small JSON document, to any store Spark writes to."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
