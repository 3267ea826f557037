"""A labelled linkage problem derived from the driver's customer tables: one clean and two noisy sources.

Corruption is deterministic, so Spark and DuckDB make equal rows from one SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = """
WITH base AS (
  SELECT c_custkey AS k, r_name AS country, n_name, concat(p_name, ' ', lower(c_mktsegment)) AS nm,
         CASE c_custkey % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' Pvt. Ltd.' ELSE '' END AS sfx,
         100 + (c_custkey * 7) % 9000 AS num
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = c_custkey % 200)
SELECT '1' AS src, concat('S1-', cast(k AS string)) AS id, country, concat(nm, sfx) AS raw_name, concat(cast(num AS string), ' ', n_name, ' St') AS raw_addr FROM base
UNION ALL
SELECT '2', concat('S2-', cast(k AS string)), country, upper(concat(nm, CASE WHEN k % 7 = 0 THEN '' ELSE sfx END)),
       CASE WHEN k % 22 = 0 THEN '' ELSE concat(CASE WHEN k % 5 = 0 THEN substr(cast(num AS string), 2) ELSE cast(num AS string) END, ' ', upper(n_name), ' ST') END
FROM base WHERE k % 10 <> 0
UNION ALL
SELECT '3', concat('S3-', cast(k AS string)), country, concat(CASE WHEN k % 6 = 0 THEN replace(nm, 'o', '0') ELSE nm END, sfx),
       concat('#', cast(num AS string), ', ', n_name, ' Street') FROM base WHERE k % 10 <> 0 AND k % 4 <> 1
UNION ALL
SELECT '2', concat('S2-', cast(10000000 + k AS string)), country, concat(nm, sfx), concat(cast(num + 2 + k % 48 AS string), ' ', n_name, ' St')
FROM base WHERE k % 3 = 0
"""
TRUTH = """
SELECT concat('S1-', cast(c_custkey AS string)) AS q, concat('S2-', cast(c_custkey AS string)) AS t FROM customer WHERE c_custkey % 10 <> 0
UNION ALL
SELECT concat('S1-', cast(c_custkey AS string)), concat('S3-', cast(c_custkey AS string)) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 4 <> 1
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region", "part")}
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RECORDS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRUTH)
