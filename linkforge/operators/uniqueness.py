"""How many records of a country share a name, an address or a street."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ["nf_s1", "nf_t", "af_s1", "afc_s1", "af_t", "afc_t", "sf_s1", "sf_t"]
FEATURES = [f"q_{c}" for c in STATS] + [f"t_{c}" for c in STATS] + ["same_ak"]


def address_keys(df: DataFrame) -> DataFrame:
    """``ak``: sorted address tokens; ``sk``: those that aren't numbers. Null without an address."""
    tokens = F.split("addr", " ")
    has = F.col("addr") != ""
    street = F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))
    return df.withColumns({"ak": F.when(has, F.array_join(F.array_sort(tokens), " ")), "sk": F.when(has, F.array_join(F.array_sort(street), " "))})


def counts(s1: DataFrame, targets: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """One table for each key with the counts of both sides; null keys have none."""
    both = s1.select("country", "core", "ak", "sk", F.lit(1).alias("one")).unionByName(targets.select("country", "core", "ak", "sk", F.lit(0).alias("one")))
    is1, ist = F.col("one") == 1, F.col("one") == 0
    name = both.groupBy("country", "core").agg(F.count_if(is1).alias("nf_s1"), F.count_if(ist).alias("nf_t"))
    # distinct names by two steps: a hot address is first reduced to its names
    steps = both.where("ak is not null").groupBy("country", "ak", "core").agg(F.count_if(is1).alias("a"), F.count_if(ist).alias("b"))
    addr = steps.groupBy("country", "ak").agg(
        F.sum("a").alias("af_s1"), F.count_if(F.col("a") > 0).alias("afc_s1"), F.sum("b").alias("af_t"), F.count_if(F.col("b") > 0).alias("afc_t"))
    street = both.where("sk is not null").groupBy("country", "sk").agg(F.count_if(is1).alias("sf_s1"), F.count_if(ist).alias("sf_t"))
    return [(["country", "core"], name), (["country", "ak"], addr), (["country", "sk"], street)]


def uniqueness(s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, ak`` and the eight counts for S1 records and for targets."""
    s1, targets = address_keys(s1), address_keys(targets)
    tables = counts(s1, targets)

    def stats(d: DataFrame) -> DataFrame:
        for keys, table in tables:
            d = d.join(table, keys, "left")
        return d.select("id", "ak", *[F.coalesce(c, F.lit(0)).alias(c) for c in STATS])

    return stats(s1), stats(targets)


def enrich(f: DataFrame, s1_stats: DataFrame, target_stats: DataFrame) -> DataFrame:
    """Pairs with both sides' counts and whether both have the same address."""
    left = s1_stats.select(F.col("id").alias("q"), F.col("ak").alias("_qa"), *[F.col(c).alias(f"q_{c}") for c in STATS])
    right = target_stats.select(F.col("id").alias("t"), F.col("ak").alias("_ta"), *[F.col(c).alias(f"t_{c}") for c in STATS])
    f = f.join(left, "q", "left").join(right, "t", "left")
    return f.withColumn("same_ak", F.coalesce(F.col("_qa") == F.col("_ta"), F.lit(False)).cast("int")).drop("_qa", "_ta").na.fill(0, FEATURES)
