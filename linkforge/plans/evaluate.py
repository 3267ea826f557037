"""Validation: recall ceiling of the candidates, thresholds, decoder powers, the best configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode, macro_f05, query_scores, threshold

THRESHOLDS = [0.3, 0.5, 0.6, 0.7]
EXCLUSIVE_THRESHOLDS = [0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8]
POWERS = [1.0, 1.5, 2.0]


def recall_ceiling(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true pairs among the candidates."""
    found = truth.select("q", "t").join(candidates.select("q", "t", F.lit(1).alias("hit")).distinct(), ["q", "t"], "left")
    return found.agg(F.count("hit").alias("n_found"), F.count(F.lit(1)).alias("n_true"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ceiling"))


def ablation(scored: DataFrame, truth: DataFrame, every: DataFrame) -> DataFrame:
    """``mode, value, f05`` of all configurations."""
    runs = [("threshold", x, threshold(scored, x, one_owner=False)) for x in THRESHOLDS]
    runs += [("exclusive", x, threshold(scored, x)) for x in EXCLUSIVE_THRESHOLDS]
    runs += [("decoder", x, decode(scored, power=x)) for x in POWERS] + [("decoder_shared", 1.0, decode(scored, one_owner=False))]
    out = None
    for mode, value, pred in runs:
        row = macro_f05(pred, truth, every).select(F.lit(mode).alias("mode"), F.lit(float(value)).alias("value"), "f05")
        out = row if out is None else out.unionByName(row)
    return out


def best_config(table: DataFrame) -> dict:
    """The best exclusive threshold or decoder power."""
    r = table.where("mode in ('exclusive', 'decoder')").orderBy(F.desc("f05"), "mode", "value").first()
    return {"mode": r.mode, "value": r.value, "f05": r.f05}


def by_country(pred: DataFrame, truth: DataFrame, every: DataFrame) -> DataFrame:
    """Macro F0.5 of each country; ``every`` has q and country."""
    return query_scores(pred, truth, every).join(every, "q").groupBy("country").agg(F.avg("f").alias("f05"), F.count(F.lit(1)).alias("n"))


def apply_config(scored: DataFrame, config: dict) -> DataFrame:
    if config["mode"] == "exclusive":
        return threshold(scored, config["value"])
    return decode(scored, power=config["value"])
