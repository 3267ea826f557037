"""Agreement of a candidate with its query's most probable other candidates (anchors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import kernels

# Names and order of the features that models read.
FEATURES = [
    "t_is_top",
    "anc1_p", "anc1_same", "anc1_ntset", "anc1_nns", "anc1_atset", "anc1_num",
    "anc2_p", "anc2_same", "anc2_ntset", "anc2_nns", "anc2_atset", "anc2_num",
]
SHORT_LIST, KEPT = 3, 2


def _own_lists(d: DataFrame) -> DataFrame:
    """``q, t, src, place, anchors``: a candidate's place among its query's, and the best others, in order."""
    ranked = d.select("q", "t", "src", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p1"), "t")).alias("place"), "p1")
    entry = F.struct(F.col("place").alias("r"), F.col("t").alias("aid"), F.col("p1").alias("ap"), F.col("src").alias("asrc"))
    best = F.array_sort(F.collect_list(F.when(F.col("place") <= SHORT_LIST, entry)).over(Window.partitionBy("q")))
    return ranked.select("q", "t", "src", "place", F.slice(F.filter(best, lambda a: a["aid"] != F.col("t")), 1, KEPT).alias("anchors"))


def anchor_pairs(d: DataFrame) -> DataFrame:
    """For each candidate up to two anchors: ``q, t, src, aid, ap, asrc, k``. A query's best three make the
    short list; the candidate itself is left out."""
    return _own_lists(d).select("q", "t", "src", F.posexplode("anchors").alias("i", "a")).select(
        "q", "t", "src", "a.aid", "a.ap", "a.asrc", (F.col("i") + 1).alias("k"))


def anchor_features(d: DataFrame, records: DataFrame) -> DataFrame:
    """13 features for each pair of ``d`` (q, t, src, p1); ``records`` (id, core, addr, nums). -1: no such anchor.

    Both anchors of a candidate stand in its row, so all similarities come from one kernel call.
    """
    rows = _own_lists(d).withColumns({f"_{k}": F.get("anchors", F.lit(k - 1)) for k in (1, 2)})
    texts = records.select("id", F.struct("core", "addr", "nums", F.replace("core", F.lit(" "), F.lit("")).alias("close")).alias("_text"))
    for name, key in (("_own", F.col("t")), ("_text1", F.col("_1.aid")), ("_text2", F.col("_2.aid"))):
        rows = rows.join(texts.select(F.col("id").alias(f"{name}_id"), F.col("_text").alias(name)), key == F.col(f"{name}_id"), "left")
    wanted = {}
    for k in (1, 2):
        for feature, kernel, part in (("ntset", "token_set", "core"), ("nns", "ratio", "close"), ("atset", "token_set", "addr"), ("num", "token_set", "nums")):
            wanted[f"anc{k}_{feature}"] = (kernel, F.col(f"_own.{part}"), F.col(f"_text{k}.{part}"))
    rows = rows.withColumn("_alike", kernels(wanted))
    values = {"t_is_top": (F.col("place") == 1).cast("int")}
    for k in (1, 2):
        found = F.col(f"_{k}").isNotNull()
        own = {"p": F.col(f"_{k}.ap"), "same": (F.col(f"_{k}.asrc") == F.col("src")).cast("int")}
        for name in (f for f in FEATURES if f.startswith(f"anc{k}_")):
            value = own.get(name.partition("_")[2], F.col(f"_alike.{name}"))
            values[name] = F.when(found, value).otherwise(F.lit(-1))
    return rows.select("q", "t", *[values[name].alias(name) for name in FEATURES])
