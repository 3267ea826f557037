"""Normalisation of records as they arrive: stateless, so the batch expressions serve a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalise


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """TSV files of records as they appear in ``folder``."""
    schema = "id string, raw_name string, raw_addr string, country string"
    return spark.readStream.schema(schema).csv(folder, sep="\t", header=True, quote="", escape="").na.fill("")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Normalised records to Parquet, exactly once; ends when all present files are read."""
    return normalise(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
