"""Candidate generation: two TF-IDF views and a top-k cosine similarity join per (country, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DF, MIN_CAP = 0.002, 50
DIGITS = 6
"""Scores closer than this are ties, broken by id; so ranks don't depend on the order of a sum."""


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas a plain Column would be computed anew for
    every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(tokens: Column, kind: str) -> Column:
    """Hashes of neighbouring tokens; ``tokens`` should be bound by ``let``."""
    firsts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(firsts, lambda t, i: F.xxhash64(F.lit(kind), t, F.get(tokens, i + 1)))


def marked(tokens: Column, kind: str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(F.lit(kind), t))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_features(core: Column, addr: Column) -> Column:
    """Name and address words, their bigrams, and the sorted name as one feature, as distinct 64-bit hashes."""
    def name(n: Column) -> Column:
        whole = F.filter(F.array(F.array_join(F.sort_array(n), "")), lambda w: w != "")
        return F.concat(marked(n, "n"), bigrams(n, "nb"), marked(whole, "ns"))

    def address(a: Column) -> Column:
        return F.concat(marked(a, "a"), bigrams(a, "ab"))

    return F.array_distinct(F.concat(let(tokens_of(core), name), let(tokens_of(addr), address)))


def char_features(core: Column, size: int = 4) -> Column:
    """Character n-grams without spaces, as distinct 64-bit hashes."""
    def grams(s: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(s) - (size - 1)), lambda i: F.xxhash64(F.substring(s, i, F.lit(size))))
        return F.when(F.length(s) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return let(F.replace(core, F.lit(" "), F.lit("")), grams)


def weights(docs: DataFrame, max_df: float = MAX_DF, min_cap: int = MIN_CAP) -> DataFrame:
    """L2-normalised TF-IDF weights of ``docs`` (part, side, id, hashed features): ``part, side, id, feature, w``.

    ``part`` is one search (country and source). Counts run over both sides of it. Features in more documents
    than max(max_df * n, min_cap) are dropped before any join: they tell little, and the cap bounds what one
    join key can produce.
    """
    n = docs.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    long = docs.select("part", "side", "id", F.explode("features").alias("feature"))
    df = long.groupBy("part", "feature").agg(F.count(F.lit(1)).alias("df"))
    # parts are few (countries x sources); Spark decides on their size
    df = df.join(n, "part").where(F.col("df") <= F.greatest(F.lit(max_df) * F.col("n"), F.lit(float(min_cap))))
    idf = df.select("part", "feature", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    # keys that differ most come first: sorts compare the first key's leading bytes before all else
    long = long.join(idf, ["feature", "part"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("id", "part", "side")))
    return long.select("part", "side", "id", "feature", (F.col("idf") / norm).alias("w"))


def shared_features(w: DataFrame, name: str = "x") -> DataFrame:
    """``part, q, t, <name>``: a row for each feature that a query and a target share, with the weights' product."""
    left = w.where("side = 'q'").select("part", "feature", F.col("id").alias("q"), F.col("w").alias("wq"))
    right = w.where("side = 't'").select("part", "feature", F.col("id").alias("t"), F.col("w").alias("wt"))
    return left.join(right, ["feature", "part"]).select("part", "q", "t", (F.col("wq") * F.col("wt")).alias(name))


def summed(products: DataFrame, *names: str) -> DataFrame:
    """Cosines by (part, q, t). Dealt by query once: sums, and ranks within a query after them, need no other
    shuffle. The products of one pair come from different tasks, so adding them up before would save little."""
    return products.repartition("q", "part").groupBy("part", "q", "t").agg(*[F.round(F.sum(n), DIGITS).alias(n) for n in names])


def pair_scores(w: DataFrame) -> DataFrame:
    """Cosine of every query and target that share a feature: ``part, q, t, score``."""
    return summed(shared_features(w, "score"), "score")


def top_k(scores: DataFrame, k: int, thr: float) -> DataFrame:
    """The k best targets of each query with a score above ``thr``; adds ``r``."""
    order = Window.partitionBy("q", "part").orderBy(F.desc("score"), "t")
    return scores.where(F.col("score") > thr).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def topk_join(docs: DataFrame, k: int, thr: float, max_df: float = MAX_DF, min_cap: int = MIN_CAP) -> DataFrame:
    return top_k(pair_scores(weights(docs, max_df, min_cap)), k, thr)


def topk_others(docs: DataFrame, k: int, thr: float, max_df: float = MAX_DF, min_cap: int = MIN_CAP) -> DataFrame:
    """The same where queries are among the targets: a document is not its own match."""
    return top_k(pair_scores(weights(docs, max_df, min_cap)).where("q <> t"), k, thr)


def two_views(word: DataFrame, char: DataFrame, k_word: int, k_char: int, thr_word: float, thr_char: float) -> DataFrame:
    """Union of both views' top lists with both exact scores, ``part, q, t, w, c``, from their weights.

    Products of both views go through one sum, so a pair has both scores at once: no join of the views, and one
    shuffle for sums and ranks together.
    """
    zero = F.lit(0.0)
    both = shared_features(word, "w").withColumn("c", zero).unionByName(shared_features(char, "c").withColumn("w", zero))
    both = summed(both, "w", "c").where((F.col("w") > thr_word) | (F.col("c") > thr_char))
    rank = {n: F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc(n), "t")) for n in "wc"}
    both = both.withColumns({"_rw": rank["w"], "_rc": rank["c"]})
    both = both.where((F.col("w") > thr_word) & (F.col("_rw") <= k_word) | (F.col("c") > thr_char) & (F.col("_rc") <= k_char))
    return both.select("part", "q", "t", "w", "c")


def search_docs(s1: DataFrame, targets: DataFrame, features: Column) -> DataFrame:
    """Documents of all searches: each S1 record once for each source that has targets in its country."""
    parts = targets.select("country", "src").distinct()
    part = F.concat_ws("|", "country", "src").alias("part")
    left = s1.drop("src").join(parts, "country").select(part, F.lit("q").alias("side"), "id", features.alias("features"))
    right = targets.select(part, F.lit("t").alias("side"), "id", features.alias("features"))
    return left.unionByName(right)


def block(s1: DataFrame, targets: DataFrame, k_word=24, k_char=12, thr_word=0.05, thr_char=0.2, max_df=MAX_DF, min_cap=MIN_CAP) -> DataFrame:
    """Candidate pairs ``country, src, q, t, w, c``; candidates never cross countries or sources."""
    word = weights(search_docs(s1, targets, word_features(F.col("core"), F.col("addr"))), max_df, min_cap)
    char = weights(search_docs(s1, targets, char_features(F.col("core"))), max_df, min_cap)
    found = two_views(word, char, k_word, k_char, thr_word, thr_char)
    return found.select(F.expr("left(part, length(part) - 2)").alias("country"), F.expr("right(part, 1)").alias("src"), "q", "t", "w", "c")
