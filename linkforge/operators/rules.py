"""Rewrite rules: mining from labelled pairs, merging, and applying them to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import core_tokens, joined, legal_forms, lookup, rule_of

MOST_RULES = 100_000
"""Rules become part of the plan; more than these are refused. Mining asks for support, so there are some hundreds."""
SCHEMA = "scope string, country string, field string, x string, y string"


def aligned(pairs: DataFrame, s1: DataFrame, targets: DataFrame, field: str) -> DataFrame:
    """Token lists of both sides of each pair: ``a`` of the clean record, ``b`` of the noisy one."""
    left = s1.select(F.col("id").alias("q"), F.split(field, " ").alias("a"))
    right = targets.select(F.col("id").alias("t"), F.split(field, " ").alias("b"))
    return pairs.join(left, "q").join(right, "t").select("a", "b")


def _rated(lists: DataFrame, xy: DataFrame) -> DataFrame:
    """Counts of (x, y) with confidence n / all y of x and support n / pairs whose noisy side has x."""
    seen = lists.select(F.explode(F.array_distinct("b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("occ"))
    counts = xy.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("x").agg(F.sum("n").alias("tot"))
    return counts.join(total, "x").join(seen, "x").withColumns({"conf": F.col("n") / F.col("tot"), "support": F.col("n") / F.col("occ")})


def mine(pairs, s1, targets, field, min_count=30, min_conf=0.6, min_support=0.3) -> DataFrame:
    """Rules x -> y from pairs that differ by exactly one token on each side; neither may be a number."""
    lists = aligned(pairs, s1, targets, field)
    xy = lists.select(F.array_except("b", "a").alias("x"), F.array_except("a", "b").alias("y")).where("size(x) = 1 and size(y) = 1")
    xy = xy.select(F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y")).where("x <> '' and y <> ''")
    return _rated(lists, xy).where(
        (F.col("n") >= min_count) & (F.col("conf") >= min_conf) & (F.col("support") >= min_support)
        & ~F.col("x").rlike("^[0-9]+$") & ~F.col("y").rlike("^[0-9]+$"))


def mine_multi(pairs, s1, targets, field, min_count=20, min_conf=0.6, min_support=0.3) -> DataFrame:
    """Rules x -> phrase of one to three sorted tokens."""
    lists = aligned(pairs, s1, targets, field)
    xy = lists.select(F.array_except("b", "a").alias("x"), F.array_except("a", "b").alias("y")).where("size(x) = 1 and size(y) between 1 and 3")
    xy = xy.select(F.get("x", F.lit(0)).alias("x"), F.array_join(F.array_sort("y"), " ").alias("y"))
    return _rated(lists, xy).where(
        (F.col("n") >= min_count) & (F.col("conf") >= min_conf) & (F.col("support") >= min_support)
        & ~F.col("x").rlike("^[0-9]+$") & (F.col("x") != "") & (F.col("y") != ""))


def mine_positional(pairs, s1, targets, min_count=3, min_conf=0.5, only_indic=True) -> DataFrame:
    """Rules from names with equally many tokens, token by token; for names in a non-Latin script."""
    lists = aligned(pairs, s1, targets.where("indic = 1") if only_indic else targets, "nm").where("size(a) = size(b)")
    xy = lists.select(F.explode(F.arrays_zip("b", "a")).alias("z")).select(F.col("z.b").alias("x"), F.col("z.a").alias("y"))
    counts = xy.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("x").agg(F.sum("n").alias("tot"))
    return counts.join(total, "x").withColumn("conf", F.col("n") / F.col("tot")).where(
        (F.col("n") >= min_count) & (F.col("conf") >= min_conf) & (F.col("x") != F.col("y")))


def merge(by_source: list[DataFrame]) -> DataFrame:
    """One rule for each x: that of the first source; within a source the most frequent, then the first y."""
    from pyspark.sql import Window

    every = None
    for i, r in enumerate(by_source):
        r = r.select("x", "y", "n", F.lit(i).alias("at"))
        every = r if every is None else every.unionByName(r)
    w = Window.partitionBy("x").orderBy("at", F.desc("n"), "y")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("x", "y")


def without_chains(rules: DataFrame) -> DataFrame:
    """Drops rules whose variant is a word of some rule's target, so no token is rewritten twice."""
    goals = rules.select(F.explode(F.split("y", " ")).alias("x")).distinct()
    return rules.join(goals, "x", "left_anti")


def as_maps(rules: DataFrame) -> dict:
    """Rules (few hundred) as nested dicts: nm, addr, translit, by_country."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rewrite rules: raise the support that mining asks for")
    out: dict = {"nm": {}, "addr": {}, "translit": {}, "by_country": {}}
    for r in rules.orderBy("scope", "country", "field", "x").collect():
        if r.scope == "country":
            out["by_country"].setdefault(r.country, {"nm": {}, "addr": {}})[r.field][r.x] = r.y
        else:
            out[r.field][r.x] = r.y
    return out


def from_maps(spark: SparkSession, maps: dict) -> DataFrame:
    rows = [("all", "", f, x, y) for f in ("nm", "addr", "translit") for x, y in maps.get(f, {}).items()]
    rows += [("country", c, f, x, y) for c, m in maps.get("by_country", {}).items() for f in m for x, y in m[f].items()]
    return spark.createDataFrame(rows, SCHEMA)


def _by_country(text, field: str, rules: dict):
    """Applies the rules of each record's own country; one table holds those of all countries."""
    table = {f"{country}\x1f{x}": y for country, own in sorted(rules.items()) for x, y in own.get(field, {}).items()}
    if not table:
        return text
    return joined(F.transform(F.split(text, " "), lambda t: F.coalesce(rule_of(F.concat(F.col("country"), F.lit("\x1f"), t), table), t)))


def rewrite(records: DataFrame, maps: dict) -> DataFrame:
    """Applies rules to ``nm`` and ``addr`` and derives ``core`` and ``legal`` anew; ``nums`` stay.

    Order: transliteration (only records with ``indic = 1``), general rules, rules of the record's country.
    """
    nm, addr = F.split("nm", " "), F.split("addr", " ")
    if maps.get("translit"):
        nm = F.when(F.col("indic") == 1, lookup(nm, maps["translit"])).otherwise(nm)
    nm, addr = lookup(nm, maps.get("nm", {})), lookup(addr, maps.get("addr", {}))
    nm, addr = joined(nm), joined(addr)
    nm, addr = (_by_country(text, field, maps.get("by_country", {})) for text, field in ((nm, "nm"), (addr, "addr")))
    out = records.withColumns({"nm": nm, "addr": addr}).withColumn("_t", F.split("nm", " "))
    return out.withColumns({"core": joined(core_tokens(F.col("_t"))), "legal": joined(legal_forms(F.col("_t")))}).drop("_t")
