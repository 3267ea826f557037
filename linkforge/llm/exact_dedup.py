"""Exact dedup: group by a 128-bit content hash, keep the best row, compare bytes in every group.

Only DataFrame functions are used. Texts are equal when identical after all white space
``[\\x20\\x09-\\x0D]`` is deleted; a null text counts as empty, so null, empty and blank texts form one
group. Of equal texts the row with most code points stays, then the smallest id (null ids come last). Of rows
repeated with one id one stays: in ``decisions`` any of them, as they give equal rows, in ``drop_copies`` the one
whose columns come first as JSON. Extra columns pass through untouched. An empty table gives an empty result.

Best rows are written before they are joined back: a join of two written tables is one whose hot groups Spark
splits at run time, which it doesn't do with an aggregate on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, strip_white

COLLIDED_ROWS_BROADCAST = 10_000


def _hashed(docs: DataFrame, id_col: str, text: str, hash_of, whole: bool = False) -> DataFrame:
    """``_id, _norm, _h, _len`` for each row, and the row itself as a struct ``_doc`` if ``whole``."""
    body = F.col(text)
    rows = docs.select(
        F.col(id_col).alias("_id"), strip_white(body).alias("_norm"), F.length(F.coalesce(body, F.lit(""))).alias("_len"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("_doc")] if whole else []))
    return rows.withColumn("_h", hash_of(F.col("_norm")))


def md5_128(col):
    return F.unhex(F.md5(col))


def decisions(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of=md5_128) -> DataFrame:
    """A row for each row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256``."""
    stages = Stages(docs.sparkSession)
    rows = _classed(docs, id_col, text, hash_of, stages).select(
        "_id", "_h", "_class", "_len", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = stages.put(rows)
    best = rows.groupBy("_h", "_class").agg(
        F.min(F.struct(-F.col("_len"), F.col("_id").isNull(), "_id", "_row")).alias("_best"),
        F.count(F.lit(1)).alias("group_size"))
    best = stages.put(best)
    out = rows.join(best, ["_h", "_class"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_best._id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def _classed(docs: DataFrame, id_col: str, text: str, hash_of, stages: Stages, whole: bool = False) -> DataFrame:
    """The hashed rows with ``_class``, which tells different texts of one hash apart."""
    rows = _hashed(docs, id_col, text, hash_of, whole)
    texts = rows.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_n"))
    # The aggregate by (hash, text) compares whole texts byte by byte. Copies meet in its map-side half, so
    # the largest group reaches the shuffle as one row a task. Texts are gathered for collided hashes only.
    many = stages.put(texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_h"))
    if many.isEmpty():
        stages.free(many)
        return rows.withColumn("_class", F.lit(0))
    found = texts.join(many, "_h", "left_semi").groupBy("_h").agg(F.array_sort(F.collect_set("_norm")).alias("_all"))
    found = stages.put(found.select("_h", F.posexplode("_all").alias("_class", "_norm")))
    stages.free(many)
    side = F.broadcast(found) if found.count() <= COLLIDED_ROWS_BROADCAST else found
    return rows.join(side, ["_h", "_norm"], "left").withColumn("_class", F.coalesce("_class", F.lit(0)))


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of=md5_128) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    stages = Stages(docs.sparkSession)
    rows = _classed(docs, id_col, text, hash_of, stages, whole=True)
    best = rows.groupBy("_h", "_class", "_len", "_id").agg(F.count(F.lit(1)).alias("_same")).groupBy("_h", "_class").agg(
        F.min(F.struct(-F.col("_len"), F.col("_id").isNull(), "_id", "_same")).alias("_b"))
    best = stages.put(best.select(
        F.col("_h").alias("_bh"), F.col("_class").alias("_bc"), (-F.col("_b.col1")).alias("_bl"),
        F.col("_b._id").alias("_bid"), F.col("_b._same").alias("_same")))
    # the id takes part in the key, so a large group of copies is dealt evenly
    kept = rows.join(best, (F.col("_h") == F.col("_bh")) & (F.col("_class") == F.col("_bc"))
                     & (F.col("_len") == F.col("_bl")) & F.col("_id").eqNullSafe(F.col("_bid")))
    once = kept.where("_same = 1").select("_doc.*")
    again = kept.where("_same > 1").groupBy("_h", "_class").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")
    return once.unionByName(again)


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
