"""Mixing sources to target weights by Poisson replication.

Each source gets the mean repetition rate that brings its share of characters to its target weight. A
document's number of copies is a Poisson variate with that mean, inverted from a uniform number that only
depends on the seed and the id, so every run and every retry gives the same copies. Copies are then dealt
over the whole cluster and sorted by a hash: a global shuffle of the corpus. As the hash is uniform, its leading
bits name the partition; no pass over the data is needed to find ranges. The quantiles of the Poisson distribution
are worked out once for each source.

Null ids share the key ``null``, repeated rows get equal counts, null texts weigh nothing and null sources
form a source of their own. Sources without a listed weight share ``1 - sum(listed)`` evenly. A source
without characters has rate 1. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

SEED = "mix-1"
WEIGHTS = {"src0": 0.15}
"""Production targets: the dominating source is held to 15 %, all others share the rest evenly."""
EPOCHS = 1.0
PART = 16.0
"""Largest mean inverted at once; a larger rate is a sum of independent variates with smaller means."""


def rates(docs: DataFrame, weights: dict[str, float], epochs: float, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each source: ``source, mass, rate``."""
    mass = docs.groupBy(source).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("mass"))
    listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
    mass = Stages(docs.sparkSession).put(mass.withColumn("_w", F.try_element_at(listed, F.coalesce(F.col(source), F.lit("")))))
    total, free = mass.agg(F.sum("mass"), F.count_if(F.col("_w").isNull())).first()
    share = F.coalesce(F.col("_w"), F.lit(1.0 - sum(weights.values())) / F.lit(free))
    rate = F.when(F.col("mass") > 0, share * F.lit(float(total or 0)) * F.lit(epochs) / F.col("mass")).otherwise(F.lit(1.0))
    return mass.select(source, "mass", rate.alias("rate"))


def uniform(seed: str, *keys):
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *keys)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_cdf(mean):
    """Values of the Poisson distribution function for a mean of at most PART, as an array; the quantile of a
    uniform number is how many of them it reaches. Values end where the tail lies under 2**-52, the resolution of
    the uniform numbers."""
    top = int(PART + 12 * math.sqrt(PART) + 12)
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(top)), start,
        lambda s, k: F.struct(
            (s["term"] * mean / k).alias("term"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["term"] * mean / k)).alias("cdf")))
    return F.filter(done["cdf"], lambda c: c <= 1 - 2.0 ** -52)


def parts(rate):
    """Rates over PART are sums of independent parts."""
    return F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")


def copies(number_of_parts, cdf, key, seed: str = SEED):
    """Number of copies: the quantiles of one uniform number for each part, added."""
    numbers = F.transform(F.sequence(F.lit(1), number_of_parts), lambda k: uniform(seed, key, k.cast("string")))
    return F.aggregate(F.transform(numbers, lambda u: F.size(F.filter(cdf, lambda c: u >= c))), F.lit(0), lambda a, b: a + b)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED,
        id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each row repeated by its count, in global hash order; adds ``copy, n_copies, shuffle_key``
    (in the place of columns of these names).

    The rates have a row for each source; Spark broadcasts them only under its own size threshold and
    otherwise joins by shuffle. The output has ``spark.sql.shuffle.partitions`` partitions, in hash order.
    """
    side = rates(docs, WEIGHTS if weights is None else weights, epochs, source, text).select(
        F.col(source).alias("_s"), parts(F.col("rate")).alias("_parts"), "rate")
    side = Stages(docs.sparkSession).put(side.select("_s", "_parts", poisson_cdf(F.col("rate") / F.col("_parts")).alias("_cdf")))
    rows = docs.drop("copy", "n_copies", "shuffle_key")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = rows.select(key.alias("_key"), F.col(source).alias("_source"), F.struct(*[rows[c] for c in rows.columns]).alias("_doc"))
    rows = rows.join(side, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_key", "_doc", copies(F.col("_parts"), F.col("_cdf"), F.col("_key"), seed).alias("n_copies"))
    rows = rows.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "_key", F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n
    rows = rows.withColumn("_at", F.shiftright(at, 32).cast("int")).repartitionById(n, "_at")
    return rows.sortWithinPartitions("shuffle_key").select("_doc.*", "copy", "n_copies", "shuffle_key")


ORACLE = """
WITH m AS (SELECT source, sum(length(coalesce(text, ''))) AS mass,
                  CASE WHEN source = 'src0' THEN 0.15::DOUBLE END AS w FROM documents GROUP BY source),
t AS (SELECT sum(mass)::DOUBLE AS total, count(*) FILTER (w IS NULL) AS free FROM m),
r AS (SELECT source, CASE WHEN mass > 0 THEN coalesce(w, (1.0::DOUBLE - 0.15::DOUBLE) / free) * total / mass::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM m, t),
s AS (SELECT source, rate, greatest(ceil(rate / 16.0::DOUBLE), 1)::INTEGER AS parts FROM r),
f AS (SELECT source, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0::DOUBLE) AS term FROM s, range(0, 77) AS g(k)),
cdf AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM f),
p AS (SELECT doc_id, d.source, unnest(range(1, parts + 1)) AS part FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 13))::UBIGINT / 4503599627370496::DOUBLE AS u FROM p),
n AS (SELECT doc_id, source, count(*) FILTER (u >= c) AS n FROM
      (SELECT u.doc_id, u.source, u.u, cdf.c FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source) GROUP BY doc_id, source)
SELECT doc_id, source, copy::INTEGER AS copy, n::INTEGER AS n_copies,
       md5('mix-1:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, n, unnest(range(1, n + 1)) AS copy FROM n)
"""
