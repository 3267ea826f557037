"""Queries of the linkage operators over the driver's tables, with DuckDB twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixture
from .functions import similarity, text
from .functions.lexicon import ADDR_CANON, LANDMARK, LEGAL, LEGAL_CANON, LEGAL_FORM
from .operators import anchors, blocking, decode, pairs, rules, sampling, shift, uniqueness
from .plans import evaluate, learn
from .sources import tables

K_WORD, K_CHAR = 12, 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records, kept for the session as the linkage run keeps them in its work folder."""
    return text.normalise(fixture.records(spark, sf_dir)).persist()


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("src = '1'"), df.where("src <> '1'")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- DuckDB fragments -------------------------------------------------------------------------------------
def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in values.items())}}}"


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_NAME = (r"regexp_replace(replace(translate(regexp_replace(replace(replace(lower(coalesce({0}, '')), '&', ' and '), '+', ' and '), "
         r"'(^|\s)(https?://)?(www\.)?([a-z0-9\-]+)\.(com|net|org|in|co|io|fr|us|biz|info)\b', ' \4 ', 'g'), '#-/', '   '), '''', ''), '[^a-z0-9 ]+', ' ', 'g')")
_ADDR = (r"regexp_replace(translate(regexp_replace(translate(replace(replace(lower(translate(regexp_replace(CASE WHEN {0} = '<NULL>' THEN '' ELSE coalesce({0}, '') END, "
         r"'\b[nN]\s?[°º]', ' ', 'g'), '°º#', '   ')), '<null>', ' '), 'n/a', ' '), '''’', '  '), '(\d)(st|nd|rd|th|eme|er|e)\b', '\1', 'g'), '-/', '  '), '[^a-z0-9 ]+', ' ', 'g')")
_NUM = "regexp_matches({}, '^[0-9]+$')"


def _names_sql(source: str, p: str = "") -> str:
    return f"""
{p}tok AS (SELECT *, {_WORDS.format(_NAME.format('raw_name'))} AS n FROM {source}),
{p}nam AS (SELECT *, list_filter(n, lambda x: NOT list_contains({_list(LEGAL)}, x)) AS c0,
  list_sort(list_distinct(list_transform(list_filter(n, lambda x: list_contains({_list(LEGAL_FORM)}, x)), lambda x: coalesce({_map(LEGAL_CANON)}[x], x)))) AS lf FROM {p}tok),
{p}names AS (SELECT * EXCLUDE (c0, lf, n), array_to_string(n, ' ') AS nm, array_to_string(CASE WHEN len(c0) > 0 THEN c0 ELSE n END, ' ') AS core,
  array_to_string(lf, ' ') AS legal FROM {p}nam)"""


_ADDR_SQL = f"""
adt AS (SELECT *, list_filter(list_transform({_WORDS.format(_ADDR.format('raw_addr'))},
   lambda x: CASE WHEN {_NUM.format('x')} THEN coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE coalesce({_map(ADDR_CANON)}[x], x) END), lambda x: x <> '') AS a FROM names),
prep AS (SELECT * EXCLUDE (a), array_to_string(a, ' ') AS addr, array_to_string(list_filter(a, lambda x: {_NUM.format('x')}), ' ') AS nums,
   (len(list_filter(a, lambda x: list_contains({_list(LANDMARK)}, x))) > 0)::INTEGER AS lm FROM adt)"""
PREP = f"rec AS ({fixture.RECORDS}), {_names_sql('rec')}, {_ADDR_SQL}, truth AS ({fixture.TRUTH})"
_SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


def _word_sql(core: str, addr: str) -> str:
    n, a = _SPLIT.format(core), _SPLIT.format(addr)
    grams = "list_transform(range(1, greatest(len({0}), 1)), lambda i: '{1}' || ({0})[i] || '_' || ({0})[i + 1])"
    return (f"list_distinct(list_concat(list_transform({n}, lambda x: 'n_' || x), list_transform({a}, lambda x: 'a_' || x), "
            f"{grams.format(n, 'nb_')}, {grams.format(a, 'ab_')}, CASE WHEN len({n}) > 0 THEN ['ns_' || array_to_string(list_sort({n}), '')] ELSE [] END))")


def _char_sql(core: str) -> str:
    s = f"replace({core}, ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(length({s}) - 2, 1)), lambda i: substr({s}, i, 4)))"


def _weights_sql(docs: str, p: str, min_cap: int = blocking.MIN_CAP) -> str:
    """CTEs from {docs}(part, side, id, features) to {p}w(part, side, id, f, w)."""
    return f"""
{p}l AS (SELECT part, side, id, unnest(features) AS f FROM {docs}), {p}n AS (SELECT part, count(*) AS n FROM {docs} GROUP BY part),
{p}d AS (SELECT part, f, count(*) AS df FROM {p}l GROUP BY part, f),
{p}i AS (SELECT part, f, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM {p}d JOIN {p}n USING (part) WHERE df <= greatest({blocking.MAX_DF} * n, {min_cap})),
{p}w AS (SELECT part, side, id, f, idf / sqrt(sum(idf * idf) OVER (PARTITION BY part, side, id)) AS w FROM {p}l JOIN {p}i USING (part, f))"""


def _scores_sql(docs: str, p: str, min_cap: int = blocking.MIN_CAP) -> str:
    """CTEs from {docs}(part, side, id, features) to {p}s(part, q, t, score)."""
    return f"""{_weights_sql(docs, p, min_cap)},
{p}s AS (SELECT a.part, a.id AS q, b.id AS t, round(sum(a.w * b.w), {blocking.DIGITS}) AS score FROM {p}w a JOIN {p}w b ON a.part = b.part AND a.f = b.f
   AND a.side = 'q' AND b.side = 't' GROUP BY a.part, a.id, b.id)"""


def _docs_sql(features: str) -> str:
    return f"""SELECT p.part, 'q' AS side, id, {features} AS features FROM prep JOIN (SELECT DISTINCT country, country || '|' || src AS part FROM prep WHERE src <> '1') p
   USING (country) WHERE src = '1' UNION ALL SELECT country || '|' || src, 't', id, {features} FROM prep WHERE src <> '1'"""


BLOCK = f"""{PREP}, wdocs AS ({_docs_sql(_word_sql('core', 'addr'))}), cdocs AS ({_docs_sql(_char_sql('core'))}), {_scores_sql('wdocs', 'w')}, {_scores_sql('cdocs', 'c')},
wr AS (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, t) AS r FROM ws), cr AS (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, t) AS r FROM cs),
cand AS (SELECT split_part(part, '|', 1) AS country, split_part(part, '|', 2) AS src, q, t, coalesce(wr.score, 0) AS w, coalesce(cr.score, 0) AS c
   FROM wr FULL JOIN cr USING (part, q, t) WHERE (wr.r <= {K_WORD} AND wr.score > 0.05) OR (cr.r <= {K_CHAR} AND cr.score > 0.2)),
p1 AS (SELECT *, greatest(w, c) AS p1 FROM cand)"""


def _block(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, kept like the records, and both sides."""
    s1, targets = _sides(_records(spark, sf_dir))
    return blocking.block(s1, targets, K_WORD, K_CHAR).persist(), s1, targets


def _p1(spark, sf_dir) -> DataFrame:
    """Candidates with a stand-in for the first-stage probability."""
    return _block(spark, sf_dir)[0].withColumn("p1", F.greatest("w", "c"))


# --- sources, predicates, sampling ------------------------------------------------------------------------
@query("SELECT 'S1-' || o_custkey AS q, 'S2-' || o_orderkey AS t FROM orders")
def gt_explode(spark, sf_dir):
    lists = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.concat_ws(",", F.collect_list(F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string"))), F.lit("")).alias("m"))
    return tables.explode_pairs(lists.withColumn("k", F.concat(F.lit("S1-"), F.col("o_custkey").cast("string"))), "k", "m")


@query("""SELECT 'S1-' || c_custkey AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM customer LEFT JOIN
 (SELECT o_custkey, string_agg('S2-' || o_orderkey, ',' ORDER BY o_totalprice DESC, 'S2-' || o_orderkey) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def set_tsv_output(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("q"), F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string")).alias("t"), F.col("o_totalprice").alias("p"))
    every = _table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("id"))
    return tables.set_rows(o.unionByName(o), every, "matched_entity_ids", "p")


@query("SELECT ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::UBIGINT::BIGINT % 100 AS fold, count(*) AS n FROM customer GROUP BY 1")
def hash_fold_counts(spark, sf_dir):
    return _table(spark, sf_dir, "customer").groupBy(sampling.hash100(F.col("c_custkey")).cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


_H = "(('0x' || substr(md5(id), 1, 8))::UBIGINT % 100)"


@query(f"""WITH {PREP} SELECT id, 'query' AS kind FROM prep WHERE src = '1' AND {_H} < 50 UNION ALL
SELECT id, 'target' FROM prep WHERE src <> '1' AND (id IN (SELECT t FROM truth WHERE q IN (SELECT id FROM prep WHERE src = '1' AND {_H} < 66))
  OR (id NOT IN (SELECT t FROM truth) AND {_H} < 80))""")
def subsample_orphans(spark, sf_dir):
    s1, targets = _sides(_records(spark, sf_dir))
    a, b = sampling.train_subsample(s1, targets, fixture.truth(spark, sf_dir), never_matched_pct=80)
    return a.select("id", F.lit("query").alias("kind")).unionByName(b.select("id", F.lit("target").alias("kind")))


@query(f"WITH {PREP} SELECT src, id, t FROM prep JOIN truth ON t = id WHERE nums <> '' AND length(addr) BETWEEN 5 AND 40")
def target_lookup(spark, sf_dir):
    df = _records(spark, sf_dir).where((F.col("nums") != "") & F.length("addr").between(5, 40) & ~F.col("id").startswith("S1"))
    return df.join(fixture.truth(spark, sf_dir), F.col("id") == F.col("t")).select("src", "id", "t")


@query(f"WITH {PREP} SELECT id, core, addr, nums FROM prep WHERE src <> '1' AND id IN (SELECT t FROM truth)")
def target_records(spark, sf_dir):
    return tables.target_records(_records(spark, sf_dir), fixture.truth(spark, sf_dir).select(F.col("t").alias("id")).distinct())


# --- normalisation ----------------------------------------------------------------------------------------
@query(f"WITH rec AS (SELECT id, raw_name FROM ({fixture.RECORDS}) UNION ALL SELECT 'P' || page_id, url FROM pages), {_names_sql('rec')} SELECT id, nm, core, legal FROM names")
def normalise_names(spark, sf_dir):
    df = fixture.records(spark, sf_dir).select("id", "raw_name").unionByName(
        _table(spark, sf_dir, "pages").select(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("raw_name")))
    n = df.withColumn("n", text.name_words(F.col("raw_name")))
    return n.select("id", text.joined(F.col("n")).alias("nm"), text.joined(text.core_tokens(F.col("n"))).alias("core"), text.joined(text.legal_forms(F.col("n"))).alias("legal"))


@query(f"WITH {PREP} SELECT id, addr, nums, lm FROM prep")
def normalise_addresses(spark, sf_dir):
    return _records(spark, sf_dir).select("id", "addr", "nums", "lm")


@query(r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\x{0}-\x{24F}]')::INTEGER AS indic,
 length(lower(strip_accents(replace(replace(coalesce(text, ''), 'ß', 'ss'), 'ẞ', 'ss')))) AS n_folded FROM documents""")
def fold_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.beyond_latin(F.col("text")).alias("indic"), F.length(text.fold(F.col("text"))).cast("bigint").alias("n_folded"))


@query("SELECT doc_id, md5(lower(strip_accents(replace(replace(coalesce(text, ''), 'ß', 'ss'), 'ẞ', 'ss')))) AS folded FROM documents")
def fold_document_texts(spark, sf_dir):
    """The folded texts themselves; the documents are in Latin script."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


# --- rules ------------------------------------------------------------------------------------------------
_MINE = """l AS (SELECT string_split(a.nm, ' ') AS a, string_split(b.nm, ' ') AS b FROM truth JOIN prep a ON a.id = q JOIN prep b ON b.id = t),
occ AS (SELECT x, count(*) AS occ FROM (SELECT unnest(list_distinct(b)) AS x FROM l) GROUP BY x),
d AS (SELECT list_distinct(list_filter(b, lambda x: NOT list_contains(a, x))) AS x, list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))) AS y FROM l),"""


@query(f"""WITH {PREP}, {_MINE} c AS (SELECT x[1] AS x, y[1] AS y, count(*) AS n FROM d WHERE len(x) = 1 AND len(y) = 1 GROUP BY x[1], y[1])
SELECT x, y, n, tot::BIGINT AS tot, occ, round(n / tot, 6) AS conf, round(n / occ, 6) AS support FROM c JOIN (SELECT x, sum(n) AS tot FROM c GROUP BY x) USING (x) JOIN occ USING (x)
WHERE n >= 2 AND n / tot >= 0.5 AND n / occ >= 0.3 AND NOT {_NUM.format('x')} AND NOT {_NUM.format('y')} AND x <> '' AND y <> ''""")
def mine_rules(spark, sf_dir):
    s1, targets = _sides(_records(spark, sf_dir))
    return _rounded(rules.mine(fixture.truth(spark, sf_dir), s1, targets, "nm", 2, 0.5, 0.3), "conf", "support")


@query(f"""WITH {PREP}, {_MINE} c AS (SELECT x[1] AS x, array_to_string(list_sort(y), ' ') AS y, count(*) AS n FROM d WHERE len(x) = 1 AND len(y) BETWEEN 1 AND 3 GROUP BY 1, 2)
SELECT x, y, n, tot::BIGINT AS tot, occ, round(n / tot, 6) AS conf, round(n / occ, 6) AS support FROM c JOIN (SELECT x, sum(n) AS tot FROM c GROUP BY x) USING (x) JOIN occ USING (x)
WHERE n >= 2 AND n / tot >= 0.5 AND n / occ >= 0.1 AND NOT {_NUM.format('x')} AND x <> '' AND y <> ''""")
def mine_multi(spark, sf_dir):
    s1, targets = _sides(_records(spark, sf_dir))
    return _rounded(rules.mine_multi(fixture.truth(spark, sf_dir), s1, targets, "nm", 2, 0.5, 0.1), "conf", "support")


_POSITIONAL = f"""l AS (SELECT string_split(a.nm, ' ') AS a, string_split(b.nm, ' ') AS b FROM truth JOIN prep a ON a.id = q JOIN prep b ON b.id = t),
pz AS (SELECT unnest(b) AS x, unnest(a) AS y FROM l WHERE len(a) = len(b)), pc AS (SELECT x, y, count(*) AS n FROM pz GROUP BY x, y),
pos AS (SELECT x, y, n, tot::BIGINT AS tot, n / tot AS conf FROM pc JOIN (SELECT x, sum(n) AS tot FROM pc GROUP BY x) USING (x) WHERE n >= 3 AND n / tot >= 0.5 AND x <> y)"""


@query(f"WITH {PREP}, {_POSITIONAL} SELECT x, y, n, tot, round(conf, 6) AS conf FROM pos")
def positional_rules(spark, sf_dir):
    s1, targets = _sides(_records(spark, sf_dir))
    return _rounded(rules.mine_positional(fixture.truth(spark, sf_dir), s1, targets, only_indic=False), "conf")


_REWRITES = {"nm": {"ltd": "limited", "inc": "incorporated"}, "addr": {"street": "st"}, "by_country": {"ASIA": {"nm": {"pvt": "private company"}}}}


@query(f"""WITH {PREP}, a AS (SELECT id, country, array_to_string(list_transform(string_split(nm, ' '), lambda x: coalesce({_map(_REWRITES['nm'])}[x], x)), ' ') AS nm,
 array_to_string(list_transform(string_split(addr, ' '), lambda x: coalesce({_map(_REWRITES['addr'])}[x], x)), ' ') AS addr FROM prep),
b AS (SELECT id, CASE WHEN country = 'ASIA' THEN array_to_string(list_transform(string_split(nm, ' '), lambda x: CASE WHEN x = 'pvt' THEN 'private company' ELSE x END), ' ') ELSE nm END AS raw_name, addr FROM a),
{_names_sql('b', 're')} SELECT id, nm, core, legal, addr FROM renames""")
def rewrite_tokens(spark, sf_dir):
    return rules.rewrite(_records(spark, sf_dir), _REWRITES).select("id", "nm", "core", "legal", "addr")


@query(f"""WITH {PREP}, {_POSITIONAL}, one AS (SELECT x, arg_max(y, (n, y)) AS y FROM pos GROUP BY x) SELECT x, y FROM one
WHERE x NOT IN (SELECT unnest(string_split(y, ' ')) FROM one)""")
def merged_rules(spark, sf_dir):
    s1, targets = _sides(_records(spark, sf_dir))
    return rules.without_chains(rules.merge([rules.mine_positional(fixture.truth(spark, sf_dir), s1, targets, only_indic=False)]))


# --- blocking ---------------------------------------------------------------------------------------------
def _sides_of(key: str):
    """Queries are the rows whose id is divisible by 50, targets are all rows."""
    return F.explode(F.when(F.col(key) % 50 == 0, F.array(F.lit("q"), F.lit("t"))).otherwise(F.array(F.lit("t")))).alias("side")


def _documents(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    features = blocking.word_features(F.lower(F.coalesce("text", F.lit(""))), F.lit("")).alias("features")
    return d.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").alias("id"), features, _sides_of("doc_id")).select("part", "side", "id", "features")


_DOCS = f"""d1 AS (SELECT coalesce(lang, '') AS part, doc_id AS id,
  list_distinct(list_concat(list_transform(w, lambda x: 'n_' || x), list_transform(range(1, greatest(len(w), 1)), lambda i: 'nb_' || w[i] || '_' || w[i + 1]),
    CASE WHEN len(w) > 0 THEN ['ns_' || array_to_string(list_sort(w), '')] ELSE [] END)) AS features
  FROM (SELECT *, {_SPLIT.format("lower(coalesce(text, ''))")} AS w FROM documents)),
docs AS (SELECT part, 't' AS side, id, features FROM d1 UNION ALL SELECT part, 'q', id, features FROM d1 WHERE id % 50 = 0)"""
_TOP = f"top AS (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, t) AS r FROM ks WHERE score > 0.05 AND q <> t QUALIFY r <= {K_WORD})"


@query(f"WITH {_DOCS}, {_scores_sql('docs', 'k')}, {_TOP} SELECT part, q, t, score, r::INTEGER AS r FROM top")
def topk_cosine_docs(spark, sf_dir):
    return blocking.topk_others(_documents(spark, sf_dir), K_WORD, 0.05)


@query(f"""WITH {_DOCS}, {_scores_sql('docs', 'k')}, {_TOP}, own AS (SELECT part, q, t, score FROM top QUALIFY row_number() OVER (PARTITION BY part, t ORDER BY score DESC, q) = 1)
SELECT part, q, t, score FROM own WHERE score > 0.5""")
def linked_documents(spark, sf_dir):
    """Flagship: near-equal documents found by the top-k join, each target with its best query only."""
    top = blocking.topk_others(_documents(spark, sf_dir), K_WORD, 0.05)
    best = decode.exclusive(top.select(F.struct("part", "q").alias("q"), F.struct("part", "t").alias("t"), F.col("score").alias("p")))
    return best.where("p > 0.5").select("q.part", "q.q", "t.t", F.col("p").alias("score"))


@query(f"""WITH {_DOCS}, {_weights_sql('docs', 'k')} SELECT part, side, id, count(*) AS n_features, round(sum(w), 6) AS sum_w, round(max(w), 6) AS max_w
FROM kw GROUP BY part, side, id""")
def df_cap_features(spark, sf_dir):
    """What the document frequency cap leaves of each document, and its weights."""
    w = blocking.weights(_documents(spark, sf_dir))
    return _rounded(w.groupBy("part", "side", "id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("w").alias("sum_w"), F.max("w").alias("max_w")), "sum_w", "max_w")


@query(f"""WITH p AS (SELECT 'all' AS part, p_partkey AS id, {_char_sql("lower(p_name || p_type)")} AS features FROM part),
docs AS (SELECT part, 't' AS side, id, features FROM p UNION ALL SELECT part, 'q', id, features FROM p WHERE id % 50 = 0),
{_scores_sql('docs', 'k')} SELECT part, q, t, score, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, t)::INTEGER AS r FROM ks WHERE score > 0.2 AND q <> t QUALIFY r <= {K_CHAR}""")
def char4_cosine_parts(spark, sf_dir):
    docs = _table(spark, sf_dir, "part").select(
        F.lit("all").alias("part"), _sides_of("p_partkey"), F.col("p_partkey").alias("id"),
        blocking.char_features(F.lower(F.concat("p_name", "p_type"))).alias("features"))
    return blocking.topk_others(docs, K_CHAR, 0.2)


@query(f"WITH {BLOCK} SELECT country, src, q, t, w, c FROM cand")
def union_views_full_join(spark, sf_dir):
    return _block(spark, sf_dir)[0]


# --- similarities and features ----------------------------------------------------------------------------
_PARTS = """x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS s, b.p_name AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _neighbours(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("s")).join(
        p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("t")), "a")


@query(f"WITH {_PARTS} SELECT a, b, round(1 - levenshtein(s, t) / greatest(length(s), length(t), 1), 6) AS sim FROM x")
def lev_similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", F.round(similarity.edit_similarity(F.col("s"), F.col("t")), 6).alias("sim"))


@query(f"WITH {_PARTS} SELECT a, b, round(jaro_winkler_similarity(s, t), 6) AS sim FROM x")
def jw_similarity(spark, sf_dir):
    k = similarity.kernels({"sim": ("jaro_winkler", F.col("s"), F.col("t"))})
    return _neighbours(spark, sf_dir).select("a", "b", F.round(k["sim"], 6).alias("sim"))


def _masks(short: str, text: str) -> str:
    """For each character of a text the places where ``short`` has it, as bits."""
    return (f"list_transform(string_split({text}, ''), lambda ch: coalesce(list_sum(list_transform(range(0, length({short})), "
            f"lambda i: CASE WHEN {short}[i + 1] = ch THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END)), 0::HUGEINT))")


def _lcs_sql(short: str, masks: str) -> str:
    """Length of the longest common subsequence by bit operations; strings have up to 120 characters."""
    full = f"((1::HUGEINT << length({short})::INTEGER) - 1)"
    return f"(length({short}) - bit_count(list_reduce({masks}, lambda d, m: ((d + (d & m)) | (d - (d & m))) & {full}, {full})))"


def _ratio_sql(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 200.0::DOUBLE * {_lcs_sql(a, _masks(a, b))} / (length({a}) + length({b})) END")


def _best_window_sql(short: str, long: str, masks: str) -> str:
    n, m = f"length({short})", f"length({long})"
    lo, hi = f"greatest(0, e - {n})", f"least(e, {m})"
    part = _lcs_sql(short, f"{masks}[({lo} + 1):({hi})]")
    return (f"CASE WHEN contains({long}, {short}) THEN 100.0::DOUBLE ELSE list_max(list_transform(range(1, {m} + {n}), "
            f"lambda e: 200.0::DOUBLE * {part} / ({n} + {hi} - {lo}))) END")


def _kernels_sql(source: str, out: str, wanted: dict[str, tuple[str, str, str]]) -> str:
    """CTEs that add similarities ``name: (kernel, left, right)`` to {source} as {out}, rounded."""
    first, second, third = [], [], []
    for name, (kernel, left, right) in wanted.items():
        a, b = f"{name}_a", f"{name}_b"
        if kernel == "ratio":
            first += [f"{left} AS {a}", f"{right} AS {b}"]
            third.append(f"round({_ratio_sql(a, b)}, 6) AS {name}")
        elif kernel == "token_sort":
            first += [f"array_to_string(list_sort({_SPLIT.format(x)}), ' ') AS {y}" for x, y in ((left, a), (right, b))]
            third.append(f"round({_ratio_sql(a, b)}, 6) AS {name}")
        elif kernel == "token_set":
            first += [f"list_sort(list_distinct({_SPLIT.format(x)})) AS {y}" for x, y in ((left, a), (right, b))]
            both, p, q = f"list_filter({a}, lambda x: list_contains({b}, x))", f"{name}_p", f"{name}_q"
            second += [f"array_to_string({both}, ' ') AS {name}_s", f"array_to_string(list_concat({both}, list_filter({a}, lambda x: NOT list_contains({b}, x))), ' ') AS {p}",
                       f"array_to_string(list_concat({both}, list_filter({b}, lambda x: NOT list_contains({a}, x))), ' ') AS {q}"]
            part = [f"200.0::DOUBLE * length({name}_s) / (length({name}_s) + length({x}))" for x in (p, q)]
            third.append(f"round(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 WHEN {name}_s <> '' AND ({p} = {name}_s OR {q} = {name}_s) THEN 100.0 "
                         f"ELSE greatest({_ratio_sql(p, q)}, CASE WHEN {name}_s <> '' THEN greatest({part[0]}, {part[1]}) ELSE 0.0 END) END, 6) AS {name}")
        elif kernel == "partial":
            swap = f"length({left}) > length({right})"
            first += [f"CASE WHEN {swap} THEN {right} ELSE {left} END AS {a}", f"CASE WHEN {swap} THEN {left} ELSE {right} END AS {b}"]
            second += [f"{_masks(a, b)} AS {name}_m", f"CASE WHEN length({a}) = length({b}) THEN {_masks(b, a)} END AS {name}_n"]
            third.append(f"round(CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 100.0 ELSE 0.0 END WHEN length({a}) = length({b}) "
                         f"THEN greatest({_best_window_sql(a, b, f'{name}_m')}, {_best_window_sql(b, a, f'{name}_n')}) ELSE {_best_window_sql(a, b, f'{name}_m')} END, 6) AS {name}")
        else:
            third.append(f"round(jaro_winkler_similarity({left}, {right}), 6) AS {name}")
    second = second or ["1 AS no_step"]
    return (f"{out}1 AS (SELECT *, {', '.join(first)} FROM {source}), {out}2 AS (SELECT *, {', '.join(second)} FROM {out}1), "
            f"{out} AS (SELECT *, {', '.join(third)} FROM {out}2)")


@query(f"""WITH {_PARTS}, {_kernels_sql('x', 'k', {n: (n, 's', 't') for n in ('ratio', 'token_sort', 'token_set', 'partial')})}
SELECT a, b, ratio, token_sort, token_set, partial FROM k""")
def indel_kernels(spark, sf_dir):
    names = ("ratio", "token_sort", "token_set", "partial")
    k = similarity.kernels({n: (n, F.col("s"), F.col("t")) for n in names})
    return _neighbours(spark, sf_dir).withColumn("k", k).select("a", "b", *[F.round(F.col("k")[n], 6).alias(n) for n in names])


_SETS = """s AS (SELECT cand.*, a.nums AS an, b.nums AS bn, string_split(a.core, ' ') AS qc, string_split(b.core, ' ') AS tc, a.legal AS ql, b.legal AS tl, a.addr AS qa, b.addr AS ta,
  list_filter(string_split(a.nums, ' '), lambda x: x <> '') AS qn, list_filter(string_split(b.nums, ' '), lambda x: x <> '') AS tn FROM cand JOIN prep a ON a.id = q JOIN prep b ON b.id = t),
f AS (SELECT country, src, q, t, w, c, len(qn) AS num_q, len(tn) AS num_t, len(list_intersect(qn, tn)) AS num_inter, len(list_distinct(list_concat(qn, tn))) AS num_union,
  coalesce(qn[1] = tn[1], false)::INTEGER AS num_first_eq, coalesce(contains(qn[1], tn[1]) OR contains(tn[1], qn[1]), false)::INTEGER AS num_first_sub,
  len(qc) AS core_q, len(tc) AS core_t, len(list_intersect(qc, tc)) AS core_inter, (qc[1] = tc[1])::INTEGER AS core_first_eq,
  CASE WHEN ql = '' OR tl = '' THEN 0 WHEN ql = tl THEN 1 ELSE 2 END AS legal_state, (qa = '')::INTEGER + 2 * (ta = '')::INTEGER AS a_empty FROM s),
g AS (SELECT *, num_inter / greatest(num_union, 1) AS num_jac, core_inter / greatest(core_q + core_t - core_inter, 1) AS core_jac FROM f)"""


def _set_features(spark, sf_dir) -> DataFrame:
    return pairs.set_features(pairs.with_records(*_block(spark, sf_dir)))


@query(f"""WITH {BLOCK}, {_SETS} SELECT q, t, num_q::INTEGER AS num_q, num_t::INTEGER AS num_t, num_inter::INTEGER AS num_inter, num_union::INTEGER AS num_union, num_first_eq, num_first_sub,
 core_q::INTEGER AS core_q, core_t::INTEGER AS core_t, core_inter::INTEGER AS core_inter, core_first_eq, legal_state, a_empty, round(num_jac, 6) AS num_jac, round(core_jac, 6) AS core_jac FROM g""")
def list_set_features(spark, sf_dir):
    return _rounded(_set_features(spark, sf_dir), "num_jac", "core_jac").select(
        "q", "t", "num_q", "num_t", "num_inter", "num_union", "num_first_eq", "num_first_sub", "core_q", "core_t", "core_inter", "core_first_eq",
        "legal_state", "a_empty", "num_jac", "core_jac")


_LIST = ["gap_q", "gap_t", "gap2_t", "w_gap_q", "c_gap_q", "w_gap_t"]


@query(f"""WITH {BLOCK}, {_SETS}, h AS (SELECT *, round(w + c, 6) AS sc, 100 * num_jac >= 90 AND num_first_eq = 1 AS ae, 100 * core_jac >= 90 AS ne, 100 * core_jac < 70 AS low FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY sc DESC, t) AS r_q, row_number() OVER (PARTITION BY t, src ORDER BY sc DESC, q) AS r_t FROM h)
SELECT q, t, r_q::INTEGER AS r_q, r_t::INTEGER AS r_t, count(*) OVER ts AS n_t, count(*) OVER qs AS n_q, round(sc - max(sc) OVER qs, 6) AS gap_q, round(sc - max(sc) OVER ts, 6) AS gap_t,
 round(sc - coalesce(max(CASE WHEN r_t = 2 THEN sc END) OVER ts, max(sc) OVER ts), 6) AS gap2_t, round(w - max(w) OVER qs, 6) AS w_gap_q, round(c - max(c) OVER qs, 6) AS c_gap_q,
 round(w - max(w) OVER ts, 6) AS w_gap_t, count(*) FILTER (sc > 1) OVER qs AS hi_q, count(*) FILTER (ae) OVER qs AS ae_q, count(*) FILTER (ae AND low) OVER qs AS ae_lown_q,
 count(*) FILTER (ne) OVER qs AS ne_q, count(*) FILTER (ne AND NOT ae) OVER qs AS ne_diffaddr_q, count(*) FILTER (ae) OVER ts AS ae_t, count(*) FILTER (ae AND ne) OVER ts AS ae_hin_t,
 count(*) FILTER (ne) OVER ts AS ne_t FROM i WINDOW qs AS (PARTITION BY q, src), ts AS (PARTITION BY t, src)""")
def context_windows(spark, sf_dir):
    """List-wise features; overlaps of tokens stand in for the two similarities that SQL lacks."""
    f = _set_features(spark, sf_dir).withColumns({"a_tset": 100 * F.col("num_jac"), "n_tset": 100 * F.col("core_jac")})
    return _rounded(pairs.list_features(f), *_LIST).select("q", "t", *pairs.LIST_FEATURES)


_ALIKE = {
    "n_ratio": ("ratio", "qcore", "tcore"), "n_tsort": ("token_sort", "qcore", "tcore"), "n_tset": ("token_set", "qcore", "tcore"),
    "n_partial": ("partial", "qcore", "tcore"), "n_jw": ("jaro_winkler", "qcore", "tcore"), "n_nospace": ("ratio", "qclose", "tclose"),
    "n_nospace_partial": ("partial", "qclose", "tclose"), "nm_tset": ("token_set", "qnm", "tnm"), "a_tset": ("token_set", "qa", "ta"),
    "a_tsort": ("token_sort", "qa", "ta"), "a_partial": ("partial", "qa", "ta"), "num_tset": ("token_set", "qnums", "tnums")}
_INDIC = r"regexp_matches(coalesce({}.raw_name, ''), '[^\x{{0}}-\x{{24F}}]')::INTEGER"


@query(f"""WITH {BLOCK}, {_SETS}, r AS (SELECT g.*, a.core AS qcore, b.core AS tcore, replace(a.core, ' ', '') AS qclose, replace(b.core, ' ', '') AS tclose, a.nm AS qnm, b.nm AS tnm,
  a.addr AS qa, b.addr AS ta, a.nums AS qnums, b.nums AS tnums, {_INDIC.format('b')} AS t_indic, b.lm AS t_lm, a.lm AS q_lm FROM g JOIN prep a ON a.id = q JOIN prep b ON b.id = t),
{_kernels_sql('r', 'k', _ALIKE)}
SELECT country, q, t, {', '.join(_ALIKE)}, round(1 - levenshtein(qa, ta) / greatest(length(qa), length(ta), 1), 6) AS a_lev, num_q::INTEGER AS num_q, num_t::INTEGER AS num_t,
 num_inter::INTEGER AS num_inter, num_union::INTEGER AS num_union, num_first_eq, num_first_sub, core_q::INTEGER AS core_q, core_t::INTEGER AS core_t, core_inter::INTEGER AS core_inter,
 core_first_eq, legal_state, a_empty, round(num_jac, 6) AS num_jac, round(core_jac, 6) AS core_jac, w, c, src::INTEGER AS src, t_indic, t_lm, q_lm FROM k""")
def pair_features(spark, sf_dir):
    f = pairs.pair_features(pairs.with_records(*_block(spark, sf_dir)))
    return _rounded(f, "n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "n_nospace", "n_nospace_partial", "nm_tset", "a_tset", "a_tsort", "a_partial", "a_lev", "num_tset", "num_jac", "core_jac")


_UNIQUE = """k AS (SELECT *, CASE WHEN addr <> '' THEN array_to_string(list_sort(string_split(addr, ' ')), ' ') END AS ak,
  CASE WHEN addr <> '' THEN array_to_string(list_sort(list_filter(string_split(addr, ' '), lambda x: NOT regexp_matches(x, '^[0-9]+$'))), ' ') END AS sk, src = '1' AS one FROM prep),
u AS (SELECT *, count(*) FILTER (one) OVER n AS nf_s1, count(*) FILTER (NOT one) OVER n AS nf_t, CASE WHEN ak IS NULL THEN 0 ELSE count(*) FILTER (one) OVER a END AS af_s1,
  CASE WHEN ak IS NULL THEN 0 ELSE count(*) FILTER (NOT one) OVER a END AS af_t, CASE WHEN sk IS NULL THEN 0 ELSE count(*) FILTER (one) OVER s END AS sf_s1,
  CASE WHEN sk IS NULL THEN 0 ELSE count(*) FILTER (NOT one) OVER s END AS sf_t FROM k
  WINDOW n AS (PARTITION BY country, core), a AS (PARTITION BY country, ak), s AS (PARTITION BY country, sk)),
v AS (SELECT country, ak, count(DISTINCT core) FILTER (one) AS afc_s1, count(DISTINCT core) FILTER (NOT one) AS afc_t FROM k WHERE ak IS NOT NULL GROUP BY country, ak),
uniq AS (SELECT u.*, coalesce(afc_s1, 0) AS afc_s1, coalesce(afc_t, 0) AS afc_t FROM u LEFT JOIN v USING (country, ak))"""


@query(f"WITH {PREP}, {_UNIQUE} SELECT id, {', '.join(uniqueness.STATS)} FROM uniq")
def name_address_uniqueness(spark, sf_dir):
    a, b = uniqueness.uniqueness(*_sides(_records(spark, sf_dir)))
    return a.unionByName(b).select("id", *uniqueness.STATS)


@query(f"""WITH {BLOCK}, {_UNIQUE} SELECT cand.q, cand.t, {', '.join(f'a.{c} AS q_{c}, b.{c} AS t_{c}' for c in uniqueness.STATS)}, coalesce(a.ak = b.ak, false)::INTEGER AS same_ak
FROM cand JOIN uniq a ON a.id = q JOIN uniq b ON b.id = t""")
def enriched_pairs(spark, sf_dir):
    found, s1, targets = _block(spark, sf_dir)
    return uniqueness.enrich(found, *uniqueness.uniqueness(s1, targets)).select("q", "t", *uniqueness.FEATURES)


_PROB = ["p_max_q", "p_gap_q", "p_sum_q", "p_sum_q_all", "p_max_t", "p_gap_t", "p_second_t", "p_sum_t", "p_max_other"]


@query(f"""WITH {BLOCK}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p1 DESC, q) AS rt FROM p1)
SELECT q, t, row_number() OVER (PARTITION BY q, src ORDER BY p1 DESC, t)::INTEGER AS p_rank_q, round(max(p1) OVER s, 6) AS p_max_q, round(p1 - max(p1) OVER s, 6) AS p_gap_q, round(sum(p1) OVER s, 6) AS p_sum_q,
 count(*) FILTER (p1 > 0.5) OVER s AS p_n50_q, round(sum(p1) OVER a, 6) AS p_sum_q_all, count(*) FILTER (p1 > 0.5) OVER a AS p_n50_q_all, round(max(p1) OVER b, 6) AS p_max_t,
 round(p1 - max(p1) OVER b, 6) AS p_gap_t, round(coalesce(max(CASE WHEN rt = 2 THEN p1 END) OVER b, max(p1) OVER b), 6) AS p_second_t, round(sum(p1) OVER b, 6) AS p_sum_t, round(max(p1) OVER a, 6) AS p_max_other
FROM r WINDOW s AS (PARTITION BY q, src), a AS (PARTITION BY q), b AS (PARTITION BY t)""")
def prob_context(spark, sf_dir):
    return _rounded(pairs.prob_context(_p1(spark, sf_dir).select("q", "t", "src", "p1")), *_PROB).select("q", "t", *pairs.PROB_FEATURES)


_ANCHOR = f"""top AS (SELECT q, t AS aid, p1 AS ap, src AS asrc, row_number() OVER (PARTITION BY q ORDER BY p1 DESC, t) AS r FROM p1 QUALIFY r <= 3),
anc AS (SELECT p1.q, p1.t, src, aid, ap, asrc, row_number() OVER (PARTITION BY p1.q, p1.t ORDER BY r) AS k FROM p1 JOIN top ON top.q = p1.q AND aid <> p1.t QUALIFY k <= 2)"""


@query(f"WITH {BLOCK}, {_ANCHOR} SELECT q, t, src, aid, ap, asrc, k::INTEGER AS k FROM anc")
def anchor_pairs(spark, sf_dir):
    return anchors.anchor_pairs(_p1(spark, sf_dir))


_ANCHOR_ALIKE = {"ntset": ("token_set", "o.core", "x.core"), "nns": ("ratio", "replace(o.core, ' ', '')", "replace(x.core, ' ', '')"),
                 "atset": ("token_set", "o.addr", "x.addr"), "num": ("token_set", "o.nums", "x.nums")}
_ANCHOR_ROWS = {n: (k, f"l_{n}", f"r_{n}") for n, (k, _, _) in _ANCHOR_ALIKE.items()}


@query(f"""WITH {BLOCK}, {_ANCHOR}, y AS (SELECT anc.*, {', '.join(f"coalesce({a}, '') AS l_{n}, coalesce({b}, '') AS r_{n}" for n, (_, a, b) in _ANCHOR_ALIKE.items())}
  FROM anc JOIN prep o ON o.id = anc.t JOIN prep x ON x.id = aid), {_kernels_sql('y', 'z', _ANCHOR_ROWS)},
v AS (SELECT q, t, {', '.join(f"max(CASE WHEN k = {k} THEN {v} END) AS anc{k}_{n}" for k in (1, 2) for n, v in [('p', 'ap'), ('same', '(asrc = src)::INTEGER'), *((m, m) for m in _ANCHOR_ALIKE)])}
  FROM z GROUP BY q, t)
SELECT p1.q, p1.t, (row_number() OVER (PARTITION BY p1.q ORDER BY p1 DESC, p1.t) = 1)::INTEGER AS t_is_top,
 {', '.join(f'coalesce({f}, -1) AS {f}' for f in anchors.FEATURES[1:])} FROM p1 LEFT JOIN v ON v.q = p1.q AND v.t = p1.t""")
def anchor_features(spark, sf_dir):
    df = _records(spark, sf_dir)
    out = anchors.anchor_features(_p1(spark, sf_dir).select("q", "t", "src", "p1"), df.where("src <> '1'"))
    return _rounded(out, *[c for c in anchors.FEATURES if c.endswith(("ntset", "nns", "atset", "num"))])


# --- decoding ---------------------------------------------------------------------------------------------
@query(f"WITH {BLOCK} SELECT q, t, p1 AS p FROM p1 QUALIFY p1 = max(p1) OVER (PARTITION BY t) AND p1 > 0.5")
def exclusive_threshold(spark, sf_dir):
    return decode.threshold(_p1(spark, sf_dir).withColumnRenamed("p1", "p"), 0.5)


_CONV = "list_reduce({0}, lambda d, x: list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END * x[1]), [1.0::DOUBLE])"


@query(f"""WITH {BLOCK}, l AS (SELECT q, list([p1] ORDER BY p1 DESC, t) AS p FROM p1 GROUP BY q)
SELECT q, k - 1 AS n_true, round(d[k], 6) AS prob FROM (SELECT q, {_CONV.format('p')} AS d, unnest(range(1, len(p) + 2)) AS k FROM l)""")
def poisson_binomial(spark, sf_dir):
    rows = _p1(spark, sf_dir).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("p1")).alias("o"), "t"))).alias("l"))
    lists = rows.select("q", F.transform("l", lambda x: -x["o"]).alias("p"))
    return lists.select("q", F.posexplode(decode.poisson_binomial_column(F.col("p"))).alias("n_true", "prob")).select(
        "q", F.col("n_true").cast("bigint").alias("n_true"), F.round("prob", 6).alias("prob"))


def _decode_sql(source: str, p: str, out: str) -> str:
    """CTEs from {source}(q, t, {p}) to the matches {out}(q, t, p)."""
    return f"""{out}1 AS (SELECT q, t, {p} AS p FROM {source} QUALIFY row_number() OVER (PARTITION BY t ORDER BY {p} DESC, q) = 1),
{out}2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS r FROM {out}1 WHERE p >= 0.01), {out}3 AS (SELECT q, list([p] ORDER BY r) AS p, count(*) AS n FROM {out}2 GROUP BY q),
{out}4 AS (SELECT q, n, k, {_CONV.format('p[1:k]')} AS a, {_CONV.format('p[k + 1:]')} AS b FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM {out}3)),
{out}5 AS (SELECT q, k, CASE WHEN k = 0 THEN b[1] ELSE list_sum(list_transform(range(1, k + 1), lambda x: list_sum(list_transform(range(0, n - k + 1),
   lambda y: a[x + 1] * b[y + 1] * 1.25 * x / (0.25 * (x + y) + k))))) END AS ef FROM {out}4),
{out}6 AS (SELECT q, arg_max(k, (round(ef, 12), -k)) AS k FROM {out}5 GROUP BY q), {out} AS (SELECT o.q, t, p FROM {out}2 o JOIN {out}6 b ON b.q = o.q AND r <= b.k)"""


_DECODE = _decode_sql("p1", "p1", "dec")


@query(f"WITH {BLOCK}, {_DECODE} SELECT q, t, p FROM dec")
def expected_f_decode(spark, sf_dir):
    return decode.decode(_p1(spark, sf_dir), "p1")


@query(f"WITH {BLOCK}, sharp AS (SELECT q, t, pow(p1, 1.5) AS ps FROM p1), {_decode_sql('sharp', 'ps', 'dec')} SELECT q, t, round(p, 6) AS p FROM dec")
def power_decode(spark, sf_dir):
    return _rounded(decode.decode(_p1(spark, sf_dir), "p1", power=1.5), "p")


@query(f"""WITH {BLOCK}, ex AS (SELECT q, t FROM p1 QUALIFY p1 = max(p1) OVER (PARTITION BY t) AND p1 > 0.5), m AS (SELECT id AS q, (SELECT count(*) FROM ex WHERE ex.q = id) AS k,
 (SELECT count(*) FROM truth WHERE truth.q = id) AS n_true, (SELECT count(*) FROM ex JOIN truth USING (q, t) WHERE ex.q = id) AS tp FROM prep WHERE src = '1')
SELECT q, tp, k, n_true, round(CASE WHEN k = 0 AND n_true = 0 THEN 1 ELSE 1.25 * tp / (0.25 * n_true + k) END, 6) AS f FROM m""")
def macro_f05(spark, sf_dir):
    pred = decode.threshold(_p1(spark, sf_dir).withColumnRenamed("p1", "p"), 0.5)
    every = fixture.records(spark, sf_dir).where("src = '1'").select(F.col("id").alias("q"))
    return _rounded(decode.query_scores(pred, fixture.truth(spark, sf_dir), every), "f")


@query(f"WITH {BLOCK} SELECT count(c2.q) AS n_found, count(*) AS n_true, round(count(c2.q) / count(*), 6) AS ceiling FROM truth LEFT JOIN cand c2 ON c2.q = truth.q AND c2.t = truth.t")
def recall_ceiling(spark, sf_dir):
    return _rounded(evaluate.recall_ceiling(_block(spark, sf_dir)[0], fixture.truth(spark, sf_dir)), "ceiling")


_CATS = """num AS (SELECT id, nullif(string_split(nums, ' ')[1], '') AS n FROM prep),
o AS (SELECT p1.q, p1.t, p1 AS p, a.n AS qn, b.n AS tn, count(*) FILTER (coalesce(a.n = b.n, false) AND p1 > 0.5) OVER (PARTITION BY p1.q) > 0 AS anch FROM p1 LEFT JOIN num a ON a.id = p1.q LEFT JOIN num b ON b.id = p1.t),
cats AS (SELECT q, t, p, CASE WHEN qn IS NULL OR tn IS NULL OR contains(qn, tn) OR contains(tn, qn) THEN 'base' WHEN abs(try_cast(qn AS BIGINT) - try_cast(tn AS BIGINT)) <= 10 THEN 'd10'
 WHEN abs(try_cast(qn AS BIGINT) - try_cast(tn AS BIGINT)) <= 50 THEN 'd50' WHEN abs(try_cast(qn AS BIGINT) - try_cast(tn AS BIGINT)) <= 500 THEN 'd500' ELSE 'dbig' END || '_' || anch AS cat FROM o)"""


def _cats(spark, sf_dir) -> DataFrame:
    return shift.categories(_p1(spark, sf_dir).select("q", "t", F.col("p1").alias("p")), shift.first_number(_records(spark, sf_dir)))


@query(f"WITH {BLOCK}, {_CATS} SELECT q, t, p, cat FROM cats")
def shift_categories(spark, sf_dir):
    return _cats(spark, sf_dir)


@query(f"WITH {BLOCK}, {_CATS}, {_DECODE} SELECT cat, round(count(*) / (SELECT count(DISTINCT q) FROM cats), 6) AS rate FROM dec JOIN cats USING (q, t) GROUP BY cat")
def shift_rates(spark, sf_dir):
    return _rounded(shift.rates(_cats(spark, sf_dir)), "rate")


def _shift_sql(rounds: int = 3) -> str:
    """CTEs that take half the first rates as reference and scale ``cats`` to them, as ``s0`` to ``s{rounds}``."""
    out = ["s0 AS MATERIALIZED (SELECT q, t, p, cat FROM cats)", "w0 AS (SELECT DISTINCT cat, 1.0::DOUBLE AS w FROM cats)"]
    for i in range(rounds):
        out.append(_decode_sql(f"s{i}", "p", f"m{i}"))
        out.append(f"r{i} AS MATERIALIZED (SELECT cat, count(*)::DOUBLE / (SELECT count(DISTINCT q) FROM cats) AS rate FROM m{i} JOIN s{i} USING (q, t) GROUP BY cat)")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT cat, CASE WHEN starts_with(cat, 'base') OR r.rate IS NULL THEN w ELSE w * least(1.0, coalesce(h.rate / 2, 0) / r.rate) END AS w "
                   f"FROM w{i} LEFT JOIN r{i} r USING (cat) LEFT JOIN r0 h USING (cat))")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT q, t, p * w AS p, cat FROM cats JOIN w{i + 1} USING (cat))")
    return ", ".join(out)


@query(f"WITH {BLOCK}, {_CATS}, {_shift_sql()}, {_decode_sql('s3', 'p', 'fin')} SELECT q, t, round(p, 6) AS p FROM fin")
def shift_corrected(spark, sf_dir):
    d = _cats(spark, sf_dir)
    fixed, _ = shift.correct(d, {k: v / 2 for k, v in shift.rate_map(d).items()})
    return _rounded(decode.decode(fixed), "p")


# --- learning ---------------------------------------------------------------------------------------------
def _labelled(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    f = _set_features(spark, sf_dir).withColumns({"a_tset": 100 * F.col("num_jac"), "n_tset": 100 * F.col("core_jac")})
    f = pairs.list_features(f).withColumn("fold", sampling.hash100(F.col("q")))
    feats = ["w", "c", "num_jac", "core_jac", "num_first_eq", "num_first_sub", "legal_state", "a_empty", *pairs.LIST_FEATURES]
    return learn.with_labels(f, fixture.truth(spark, sf_dir)).select("q", "t", "src", "y", "fold", *feats), feats


_SMALL = {"maxIter": 8, "maxDepth": 4, "minInstancesPerNode": 20}


@query()
def gbt_scores(spark, sf_dir):
    f, feats = _labelled(spark, sf_dir)
    f = f.localCheckpoint()
    m = learn.fit(f.where("fold < 40"), f.where("fold >= 80"), feats, **_SMALL)
    return _rounded(learn.score(m, f.where("fold >= 40")), "p").select("q", "t", "y", "p")


@query()
def stacked_scores(spark, sf_dir):
    f, feats = _labelled(spark, sf_dir)
    f = f.localCheckpoint()
    _, _, scored = learn.cross_fit(f, f.where("fold >= 80"), feats, 30, **_SMALL)
    more = pairs.prob_context(scored).localCheckpoint()  # beside the other columns: a join back would score all rows twice
    m = learn.fit(more.where("fold < 60"), more.where("fold >= 80"), [*feats, "p1", *pairs.PROB_FEATURES], **_SMALL)
    return _rounded(decode.decode(learn.score(m, more.where("fold >= 60"))), "p")
