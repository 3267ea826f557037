"""URL filters: explicit host/path rules, then association rules mined by FP-growth.

Explicit rules: the longest rule whose host is the url's host or a parent domain, and whose path starts the
url's path, decides. For all other urls the method decides: FP-growth mines combinations of url tokens that
go with bad labels; rules pruned by support, confidence and lift are matched through an inverted index
that lists each rule under its rarest token. Only DataFrame functions and ``pyspark.ml`` are used.

Mining sees all distinct tokens of a url. Two steps bound the itemsets and lose no rule: tokens on fewer bad
urls than the support asks for are in no rule and left out, and tokens that stand on the same urls have the
same support, confidence and lift in every itemset, so they are mined as one item. A rule is a list of such
groups and matches a url that has a token of each.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows
and repeated page ids are judged row by row. Extra columns are ignored. Without labels (or without pages)
no rule is mined and every url that fits no explicit rule is allowed.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, ascii_lower

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 0.002, 20, 0.6, 1.5
"""A rule holds for MIN_SUPPORT of the labelled urls and MIN_ROWS of them at least."""
BROADCAST_RULES = 10_000
BAD = "label=bad"


def split_url(url) -> tuple:
    """(host, path) of a url column."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def explicit(host, path, rules=RULES) -> tuple:
    """(rule, verdict) columns; null where no rule fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host, url):
    """Distinct tokens: ``h:`` labels of the host and ``p:`` words behind it, numbers left out."""
    rest = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit("")))
    labels = F.filter(F.split(host, r"\."), lambda t: t != "")
    words = F.filter(F.split(rest, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.rlike(r"^\p{N}+$"))
    return F.array_distinct(F.concat(F.transform(labels, lambda t: F.concat(F.lit("h:"), t)),
                                     F.transform(words, lambda t: F.concat(F.lit("p:"), t))))


def mine(pages: DataFrame, labels: DataFrame, min_support=MIN_SUPPORT, min_rows=MIN_ROWS,
         min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT, page_id="page_id", url="url") -> DataFrame:
    """Rules ``tokens, confidence, lift`` from urls whose page has a label (quality 0 or toxic 1 is bad).

    ``tokens`` is a list of groups; a url needs a token of each group.
    """
    spark = pages.sparkSession
    stages = Stages(spark)
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = pages.select(F.col(page_id).alias("doc_id"), F.col(url).alias("_u")).join(bad, "doc_id")
    host, _ = split_url(F.col("_u"))
    rows = stages.put(known.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("bad") == 1, F.lit(False)).alias("bad"),
        tokens(host, F.col("_u")).alias("items")).where("bad or size(items) > 0"))
    n = rows.count()
    empty = spark.createDataFrame([], "tokens array<array<string>>, confidence double, lift double")
    if not n:
        return empty
    support = min(1.0, max(min_support, min_rows / n))
    # each token's rows as their number and two sums of hashes; equal ones are one item
    each = rows.select("row", "bad", F.explode("items").alias("token"))
    sums = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(20)")).alias(f"s{i}") for i in (1, 2)]
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bad").cast("long")).alias("bads"), *sums)
    seen = seen.where(F.col("bads") >= math.ceil(support * n - 1e-9))
    groups = stages.put(seen.groupBy("rows", "s1", "s2").agg(F.sort_array(F.collect_list("token")).alias("group")).select(
        F.col("group")[0].alias("item"), "group"))
    held = each.join(groups.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    baskets = stages.put(rows.select("row", "bad").join(held, "row", "left").select(
        F.when(F.col("bad"), F.concat(items, F.array(F.lit(BAD)))).otherwise(items).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    return rules.select("antecedent", "confidence", "lift", F.explode("antecedent").alias("item")).join(groups, "item").groupBy(
        "antecedent", "confidence", "lift").agg(F.sort_array(F.collect_list("group")).alias("tokens")).select("tokens", "confidence", "lift")


def index(rules: DataFrame) -> DataFrame:
    """Inverted index: each rule is listed under the tokens of its group that fewest rules hold."""
    uses = rules.select(F.explode("tokens").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("uses"))
    each = rules.select("tokens", F.explode("tokens").alias("group")).join(uses, "group")
    return each.groupBy("tokens").agg(F.min(F.struct("uses", "group")).alias("m")).select(F.explode("m.group").alias("token"), F.col("tokens").alias("need"))


def blocked_urls(pages: DataFrame, rules: DataFrame, url="url") -> DataFrame:
    """Distinct urls that some mined rule matches."""
    u = F.col(url)
    urls = pages.where(u.isNotNull()).select(u.alias("_url")).distinct()
    host, _ = split_url(F.col("_url"))
    urls = urls.withColumn("_tokens", tokens(host, F.col("_url")))
    postings = Stages(pages.sparkSession).put(index(rules))
    side = F.broadcast(postings) if postings.count() <= BROADCAST_RULES else postings
    hits = urls.select("_url", "_tokens", F.explode("_tokens").alias("token")).join(side, "token")
    return hits.where(F.forall("need", lambda g: F.arrays_overlap(g, F.col("_tokens")))).select("_url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, page_id="page_id", url="url", **mining) -> DataFrame:
    """A row for each page: ``<page_id>, host, path, rule, verdict``."""
    mined = Stages(pages.sparkSession).put(mine(pages, labels, page_id=page_id, url=url, **mining))
    blocked = blocked_urls(pages, mined, url)
    u = F.col(url)
    host, path = split_url(u)
    rows = pages.select(F.col(page_id), u.alias("_u"), host.alias("host"), path.alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_v": verdict}).join(blocked, F.col("_u") == F.col("_url"), "left")
    return rows.select(page_id, "host", "path", "rule", F.coalesce("_v", F.when(F.col("_url").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _oracle() -> str:
    """DuckDB twin: every set of a labelled url's frequent tokens is counted, which needs no FP-growth."""
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in cases)
    rule, verdict = fits.format(*[h + p for _, h, p in cases]), fits.format(*[k for k, _, _ in cases])
    return rf"""
WITH s AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, lower(coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1), '')) AS rest FROM pages),
u AS (SELECT page_id, url, host, path, list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(regexp_split_to_array(rest, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^\p{{N}}+$')), lambda x: 'p:' || x))) AS items FROM s),
b AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INTEGER) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT row_number() OVER () AS r, coalesce(bad, 0) AS bad, items FROM u JOIN b ON doc_id = page_id WHERE bad = 1 OR len(items) > 0),
n AS (SELECT count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bads, least(1.0, greatest({MIN_SUPPORT}::DOUBLE, {MIN_ROWS}::DOUBLE / count(*)::DOUBLE)) AS support FROM k),
f AS (SELECT x FROM (SELECT r, bad, unnest(items) AS x FROM k), n GROUP BY x, n.n, support HAVING sum(bad) >= ceil(support * n.n - 1e-9)),
t AS (SELECT r, any_value(bad) AS bad, list(x ORDER BY x) AS items FROM (SELECT r, bad, unnest(items) AS x FROM k) SEMI JOIN f USING (x) GROUP BY r),
sets AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS need, bad FROM (SELECT *, unnest(range(1, (1 << len(items))::BIGINT)) AS m FROM t)),
rules AS (SELECT need FROM sets, n GROUP BY need, n.n, bads, support HAVING sum(bad) >= ceil(support * n.n) AND sum(bad) / count(*) >= {MIN_CONFIDENCE} AND sum(bad) / count(*) / (bads / n.n) >= {MIN_LIFT})
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(u.items, need)) THEN 'block' ELSE 'allow' END) AS verdict FROM u
"""


ORACLE = _oracle()
