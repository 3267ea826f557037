"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct 5-word shingles. The join finds every pair of sets with
``100 * |A & B| >= 80 * |A | B|`` as far as needed to know the components of the link graph:

1. Equal sets become one node.
2. Every set lists its prefix: its rarest shingles, so many that two linked sets must share one of them.
   Shingles in no other set's prefix are dropped; a set left without any has no link.
3. Sets are partitioned into groups of similar ones (equal minimum hash, at most GROUP members). Inside a
   group, sets are linked exactly; what is linked becomes one group of the matrix.
4. The matrix is the relation (shingle, group). Groups first meet only the smallest group that shares a
   shingle (this joins the chunks of a large family of near copies at linear cost). Then every set queries
   every group of another component with which it shares a prefix shingle. A group stores the union of
   its members' shingles; ``|Q & union| / |Q|`` bounds the similarity of Q to every member, and only groups
   that reach the bound are opened and compared member by member.
5. Components of all links, labelled by their smallest id.

How sets are grouped and which shingles are called frequent only affects cost, never the result.

Shingles are 64-bit hashes, sets are told apart by 128 bits. Null, empty and blank texts have an empty set
and link with nothing. Repeated rows and repeated ids are joined row by row; a row with a null id takes part
and never names a component unless all ids in it are null. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, sweep
from .groups import by_group, components

WORDS, PERCENT = 5, 80
GROUP = 256
FREQUENT_LEAST, FREQUENT_MOST = 8, 1 << 20
"""Shingles seen FREQUENT_LEAST times count as frequent and are ordered last, rarer ones first. The table goes
to every task, so it holds FREQUENT_MOST shingles (16 MB) at most: beyond, the threshold rises."""
CHUNK = 4_000_000
MEMO = 1_000_000
ROWS = 1_000
"""Documents whose texts and sets a worker holds at once."""

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64); a text of fewer words has one, a text of none has none."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    known = _words.get
    code = np.empty(n, np.uint64)
    values = [known(w) for w in found]
    for i, v in enumerate(values):
        if v is None:
            values[i] = _words[found[i]] = xxhash.xxh3_64_intdigest(found[i])
    code[:] = values
    size = min(n, words)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _PRIME + code[k: n - size + 1 + k]
    return np.unique(_mix(h))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - needed(n, percent) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets link; sizes are compared first."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = common(small, large)
    return 100 * both >= percent * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def frequent(docs: DataFrame, stages: Stages, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their counts.

    A task emits the shingles that meet twice in one of its chunks, with their counts there; sums over all
    chunks are lower bounds, which suffices for an order. Equal neighbours in a chunk count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def flush():
            flat = np.concatenate(list(held.values()))
            held.clear()
            flat.sort()
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            n = np.diff(first, append=len(flat))
            token, n = flat[first[n > 1]], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, words)
                if len(s):
                    held[len(s), int(s[0]), int(s[len(s) // 2]), int(s[-1])] = s
                    size += len(s)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counts = docs.select("_text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stages.put(counts.where(F.col("n") >= FREQUENT_LEAST))
    least, room = FREQUENT_LEAST, FREQUENT_MOST
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        room -= r.k
        if room < 0:
            least = r.n + 1
            break
    rows = counts.where(F.col("n") >= least).toArrow()
    stages.free(counts)
    token, n = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def signatures(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """``_row, _id, _key, n, sig, mh, prefix`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = shared.value
        for batch in slices(batches):
            n, sig, mh, parts = [], [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                if not len(s):
                    sig.append(None)
                    mh.append(None)
                    parts.append(s.view(np.int64))
                    continue
                sig.append(hashlib.md5(s.tobytes()).digest())
                mh.append(int(s[:1].view(np.int64)[0]))
                take = prefix_size(len(s), percent)
                if len(token):
                    at = np.searchsorted(token, s)
                    at[at == len(token)] = 0
                    weight = np.where(token[at] == s, count[at], 0)
                    s = s[np.argsort(weight, kind="stable")]
                parts.append(s[:take].copy().view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(mh, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_row", "_id", "_key", "n", "sig", "mh", "prefix"])

    return docs.select("_row", "_id", "_key", "_text").mapInArrow(
        run, "_row long, _id long, _key long, n long, sig binary, mh long, prefix array<long>")


def link_group(rows: list[dict], words: int, percent: int) -> list[tuple]:
    """Exact links inside one group: (uid, leader) for each member. A set meets the first set of each
    cluster, and the others only if it isn't linked yet; clusters that it links become one."""
    clusters: list[list[tuple[int, np.ndarray]]] = []
    for uid, text in {r["uid"]: r["text"] for r in rows}.items():
        s = shingle_set(text, words)
        hits = [c for c in clusters if any(linked(s, m, percent) for _, m in c)]
        merged = [m for c in hits for m in c] + [(uid, s)]
        clusters = [c for c in clusters if not any(c is h for h in hits)] + [merged]
    return [(uid, min(u for u, _ in c)) for c in clusters for uid, _ in c]


def qualified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``q, g`` that share enough prefix shingles, from a row ``q, n, g, n0, n1`` for each shared one.

    Two linked sets of sizes n and m have ``o >= percent * (n + m) / (100 + percent)`` shingles in common. Of
    these at most ``needed(x) - 1`` can lie behind the prefix of that one of them, of size x, whose prefix
    ends first; so at least ``o - needed(max(n, m)) + 1`` are in both prefixes. Among sizes m <= n this is least
    for the smallest. Among m > n its rounded terms jump up and down, so there it is bounded from below without
    rounding: ``(100 * percent * n - percent ** 2 * m + 100 + percent) / (100 * (100 + percent))`` falls with m,
    so its value at the largest size holds for all.
    """
    n, n0, n1 = F.col("n"), F.col("n0"), F.col("n1")

    def least(m):
        both = F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)
        return both - F.ceil(percent * F.greatest(n, m) / 100.0 - 1e-9) + 1

    lo, hi = F.greatest(n0, F.ceil(percent * n / 100.0 - 1e-9)), F.least(n1, F.floor(100.0 * n / percent + 1e-9))
    above = F.ceil((100 * percent * n - percent ** 2 * hi + 100 + percent) / (100.0 * (100 + percent)) - 1e-9)
    fewest = F.when((hi <= n) | (lo == hi), least(lo)).otherwise(F.least(least(lo), above))
    counted = pairs.groupBy("q", "g", "n", "n0", "n1").agg(F.count(F.lit(1)).alias("c")).where(lo <= hi)
    return counted.where(F.col("c") >= fewest).select("q", "g")


def open_groups(pairs: DataFrame, members: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between queries and groups: ``pairs`` (q, g), ``members`` (g, uid), ``sets`` (uid, text).

    Queries of one group are dealt in chunks of about GROUP, each with its own copy of the group.
    """
    chunks = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("k"))
    left = pairs.join(chunks, "g").select("g", F.pmod(F.xxhash64("q"), F.col("k")).cast("int").alias("c"), F.lit(1).alias("role"), F.col("q").alias("uid"))
    right = members.join(chunks, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"), F.lit(0).alias("role"), "uid")
    rows = left.union(right).hint("merge").join(sets, "uid")

    def fn(rows: list[dict]) -> list[tuple]:
        inside = {r["uid"]: r["text"] for r in rows if r["role"] == 0}
        group = [shingle_set(t, words) for t in inside.values()]
        if not group:
            return []
        union = group[0] if len(group) == 1 else np.unique(np.concatenate(group))
        out = []
        for r in rows:
            if r["role"] == 1 and r["uid"] not in inside:
                q = shingle_set(r["text"], words)
                if 100 * common(q, union) >= percent * len(q) and any(linked(q, m, percent) for m in group):
                    out.append((r["uid"], r["g"]))
        return out

    return by_group(rows, ["g", "c"], ["role"], fn, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``<id>, n_shingles, component_id``."""
    spark = docs.sparkSession
    stages = Stages(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text"))
    often = frequent(rows, stages, words)
    every = stages.put(signatures(rows, often, words, percent))
    nodes = stages.put(every.where("n > 0").groupBy("sig").agg(
        F.min("_row").alias("uid"), F.min("_id").alias("least")))

    # prefix shingles that two different sets share
    one = stages.put(every.join(nodes.select("uid").hint("merge"), F.col("_row") == F.col("uid"), "left_semi").select(
        F.col("_row").alias("uid"), "_id", "_key", "n", "mh", "prefix"))
    post = one.select("uid", F.explode("prefix").alias("token"))
    sharing = post.groupBy("token").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("token")
    # tables that are joined back are written first: Spark splits hot keys of joins of written tables only
    sharing = stages.put(sharing)
    post = stages.put(post.join(sharing.hint("merge"), "token").select("token", "uid"))
    sweep(spark)

    # groups of similar sets, and the texts of all sets that can have a link
    some = post.select("uid").distinct().join(one.drop("prefix"), "uid")
    some = stages.put(some)
    stages.free(one)
    sizes = some.groupBy("mh").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("k"), F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = some.join(sizes, "mh", "left").withColumn("c", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("uid"), F.col("k")).cast("int")))
    dealt = dealt.select("uid", F.col("_id").alias("i2"), F.col("_key").alias("k2"), "n", "mh", "c")
    sets = rows.join(dealt.hint("merge"), (F.col("_key") == F.col("k2")) & F.col("_id").eqNullSafe(F.col("i2"))).select(
        "uid", "mh", "c", F.col("_text").alias("text"))
    sets = stages.put(sets)
    sweep(spark)
    leaders = by_group(sets.where("c is not null"), ["mh", "c"], ["uid"], lambda g: link_group(g, words, percent), "uid long, leader long")
    leaders = stages.put(some.select("uid", "n").join(leaders, "uid", "left").select("uid", "n", F.coalesce("leader", "uid").alias("g")))
    texts = sets.select("uid", "text")

    # the token-group matrix; first, first members of groups against the smallest one that shares a shingle
    matrix = stages.put(post.join(leaders, "uid").select("token", "uid", "n", "g"))
    stages.free(post)
    heads = matrix.where("uid = g")
    low = heads.groupBy("token").agg(F.min(F.struct("g", "n")).alias("lo"), F.max("g").alias("hi")).where("lo.g < hi").select(
        "token", F.col("lo.g").alias("lo"), F.col("lo.n").alias("n0"))
    low = stages.put(low)
    star = heads.join(low, "token").where("g <> lo").select(F.col("g").alias("q"), "n", F.col("lo").alias("g"), "n0", F.col("n0").alias("n1"))
    star = stages.put(qualified(star, percent))
    sweep(spark)
    links = stages.put(open_groups(star, star.select("g", F.col("g").alias("uid")).distinct(), texts, words, percent))
    stages.free(star)
    sweep(spark)
    comp = components(links, stages)

    # every set against every group of another component
    with_comp = matrix.join(comp, F.col("g") == F.col("node"), "left").select("token", "uid", "n", "g", F.coalesce("comp", "g").alias("comp"))
    weight = leaders.join(comp, F.col("g") == F.col("node"), "left").groupBy(F.coalesce("comp", "g").alias("comp")).agg(F.count(F.lit(1)).alias("size"))
    weight = stages.put(weight)
    with_comp = stages.put(with_comp.join(weight, "comp"))
    two = with_comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    two, every_token = stages.put(two), with_comp
    with_comp = stages.put(every_token.join(two, "token"))
    stages.free(every_token, two, weight)
    sizes = leaders.groupBy("g").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
    groups = with_comp.select("token", "g", F.col("comp").alias("gc"), F.col("size").alias("gsize")).distinct().join(sizes, "g")
    # the sets of the smaller component query the groups of the larger one
    pairs = with_comp.drop("g").join(groups, "token").where(F.struct("size", "comp") < F.struct("gsize", "gc")).select(F.col("uid").alias("q"), "n", "g", "n0", "n1")
    pairs = stages.put(qualified(pairs, percent))
    sweep(spark)
    found = open_groups(pairs, leaders.select("g", "uid").join(pairs.select("g").distinct(), "g", "left_semi"), texts, words, percent)
    found = found.join(leaders.select(F.col("uid").alias("a"), F.col("g").alias("ga")), "a").select(F.col("ga").alias("a"), "b")
    last = components(stages.put(links.union(found)), stages)

    # component of each set, then of each row
    whole = nodes.join(leaders.select("uid", "g"), "uid", "left").join(last, F.col("g") == F.col("node"), "left").select(
        "sig", "least", F.coalesce("comp", "g", "uid").alias("comp"))
    whole = stages.put(whole)
    names = stages.put(whole.groupBy("comp").agg(F.min("least").alias("component_id")))
    named = stages.put(whole.join(names, "comp").select("sig", "component_id"))
    out = every.select("_id", "n", "sig").join(named, "sig", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    out = stages.put(out)
    stages.free(every, nodes, sharing, some, sets, leaders, matrix, low, links, comp, with_comp, pairs, last, whole, names, named)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays: the one that names it. Rows with a null id stay."""
    names = join(docs, id_col, text, words, percent).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep")).distinct()
    return docs.where(F.col(id_col).isNull()).unionByName(docs.join(names, F.col(id_col) == F.col("_keep"), "left_semi"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, hash(unnest(s)) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id FROM n LEFT JOIN m ON m.a = doc_id
"""
