"""Corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import importlib.util
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from linkforge.llm import exact_dedup, html_extract, jaccard, mixing, packing, quality, suffix_dedup, tokens, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id string, copy int, component_id int, file string"
R = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def words(n):
    return [R.choice(VOCAB) for _ in range(n)]


def near(ws, changes):
    ws = list(ws)
    for _ in range(changes):
        ws[R.randrange(len(ws))] = "new" + str(R.random())
    return ws


BASE = words(300)
TEXTS = {
    1: None, 2: "", 3: " \n", 4: "a b", 5: "A  b", 6: " ".join(BASE), 7: "\n".join(BASE), 8: " ".join(near(BASE, 4)), 9: " ".join(words(120) + BASE[:80]),
    10: " ".join(words(5000)), 11: " ".join(near(BASE, 30)), 12: " ".join(BASE) + "  ", 13: "é" * 400 + " x",
}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, True, "k", 7, 9, "f") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in TEXTS.items()] + [(None, " ".join(BASE), None), (9, TEXTS[9], "s0"), (9, TEXTS[9], "s0")]
    rows += [(100 + i, " ".join(near(BASE, 3)), "hot") for i in range(40)]
    return table(spark, rows)


def raw(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (jaccard.join(none), exact_dedup.decisions(none), exact_dedup.drop_copies(none), mixing.mix(none), quality.clean(none), suffix_dedup.digest(none),
                packing.pack(none), tokens.count_tokens(none), html_extract.extract(pages), url_filter.judge(pages, labels), warc.audit(*[warc.manifest(warc.records(pages))] * 2)):
        assert out.count() == 0


def plain_components(rows):
    """(id, set size, smallest id of the component) of each row, from all pairs."""
    sets = [set(map(int, jaccard.shingle_set(t))) for _, t in rows]
    comp = list(range(len(rows)))
    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    names: dict = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in names[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_jaccard_against_brute_force(docs):
    want = sorted(map(str, plain_components(raw(docs))))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.join(docs).collect())
    assert got == want


@pytest.mark.parametrize("partitions", ["4", "211"])
def test_jaccard_families_against_brute_force(spark, partitions):
    """Families of short texts whose pairs lie around the threshold, chained, beside passages that many texts share."""
    r = random.Random(17)
    rows = []
    for f in range(25):
        base = [f"f{f}w{k}" for k in range(r.randint(10, 60))]
        for _ in range(r.randint(2, 8)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                cut = r.choice(["head", "tail", "swap", "add"])
                if cut == "head":
                    own = own[r.randint(0, 2):]
                elif cut == "tail":
                    own = own[:len(own) - r.randint(0, 2)]
                elif cut == "add":
                    own = [*own, f"a{r.random()}"]
                else:
                    own[r.randrange(len(own))] = f"s{r.random()}"
            rows.append(" ".join(own))
            base = own if r.random() < 0.5 else base
        rows += [" ".join([f"x{r.random()}" for _ in range(40)] + base[:r.randint(5, 9)]) for _ in range(6)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, jaccard.join(table(spark, [(i, t, "s") for i, t in rows])).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == sorted(plain_components(rows))


def test_jaccard_bound_in_groups_of_mixed_sizes(spark):
    """qualified() keeps every pair that shares as few prefix shingles as some size in the group needs."""
    def least(n, m):
        return -(-80 * (n + m) // 180) - jaccard.needed(max(n, m)) + 1

    cases = []
    for n in range(1, 45):
        for n0 in range(jaccard.needed(n), n * 5 // 4 + 1):
            for n1 in range(n0, n * 5 // 4 + 1):
                cases.append((len(cases), 0, n, n0, n1, max(1, min(least(n, m) for m in range(n0, n1 + 1)))))
    rows = spark.createDataFrame(cases, "q long, g long, n long, n0 long, n1 long, k int")
    kept = jaccard.qualified(rows.withColumn("i", F.explode(F.sequence(F.lit(1), "k"))), 80)
    assert {r.q for r in kept.collect()} == {c[0] for c in cases}


def test_jaccard_link_to_middle_of_group(spark):
    """A links only with the middle one of a group of 18, 19 and 20 shingles, by one shared prefix shingle."""
    for seed in range(1000):
        r = random.Random(seed)
        p, b = [f"p{r.random()}" for _ in range(20)], [f"b{r.random()}" for _ in range(4)]
        group = [" ".join(x) for x in (p[1:] + b[:3], p + b[:3], p + b)]
        if len({int(jaccard.shingle_set(t)[0]) for t in group}) == 1 and jaccard.shingle_set(group[0])[0] in jaccard.shingle_set(" ".join(p)):
            break
    a = " ".join(["a", *p])
    assert [jaccard.linked(jaccard.shingle_set(a), jaccard.shingle_set(t)) for t in group] == [False, True, False]
    long = [" ".join([f"x{r.random()}" for _ in range(200)] + p) for _ in range(40)]
    long.append(" ".join([f"x{r.random()}" for _ in range(200)] + p[:5]))  # all shingles of p are equally frequent
    rows = [(1, a, "s"), *((2 + i, t, "s") for i, t in enumerate(group)), *((10 + i, t, "s") for i, t in enumerate(long))]
    got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows)).collect()}
    assert [got[i] for i in range(1, 5)] == [1] * 4 and all(got[10 + i] == 10 + i for i in range(41))


def test_exact_dedup(docs):
    rows = raw(docs)
    norm = lambda t: "".join(t.split(" ")).replace("\n", "")
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), d is None, d or 0, d))
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == len(rows)
    text_of = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    for r in got:
        g = groups[text_of[r.text_sha256]]
        assert (r.keep_id, r.group_size) == (min(g)[3], len(g))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {r.keep_id for r in kept.collect()} == {"k"}


def test_exact_dedup_compares_bytes(docs):
    weak = lambda c: F.unhex(F.substring(F.md5(c), 1, 2))
    order = lambda df: sorted(map(str, df.collect()))
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    assert order(exact_dedup.decisions(docs, hash_of=lambda c: F.unhex(F.lit("00"))).select(cols)) == order(exact_dedup.decisions(docs).select(cols))
    assert exact_dedup.drop_copies(docs, hash_of=weak).count() == exact_dedup.drop_copies(docs).count()


def test_suffix_dedup_against_brute_force(docs):
    rows = [(d, t.encode()) for d, t in raw(docs)]
    seen: dict = {}
    for i, (_, t) in enumerate(rows):
        for p in range(len(t) - 199):
            seen.setdefault(t[p:p + 200], []).append((i, p))
    spans: dict = {}
    for v in seen.values():
        if len(v) > 1:
            for i, p in v:
                spans.setdefault(i, []).append((p, p + 200))
    want = []
    for i, (d, t) in enumerate(rows):
        rest, cut = suffix_dedup.remove(t, spans.get(i, []))
        want.append(str((d, len(t), len(t) - len(rest), len(cut), hashlib.sha256(rest).hexdigest())))
    got = [str(tuple(r)) for r in suffix_dedup.digest(docs).collect()]
    assert sorted(got) == sorted(want)


def test_suffix_dedup_hot_anchor(docs, monkeypatch):
    want = sorted(map(str, suffix_dedup.digest(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert sorted(map(str, suffix_dedup.digest(docs).collect())) == want
    for most in (0, 3):
        monkeypatch.setattr(suffix_dedup, "HUGE", most)
        assert sorted(map(str, suffix_dedup.digest(docs).collect())) == want


def test_mixing_reaches_weights(spark):
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(d, {"a": 0.75}, epochs=30.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.75) < 0.01 and abs(sum(n.values()) / 900_000 - 1) < 0.01
    counts = mixing.mix(d, {"a": 0.75}, epochs=1.0).where("source = 'a'").groupBy("doc_id").count().agg(F.count("*"), F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1))).first()
    assert abs(counts[1] / 10_000 - 2.25) < 0.06 and abs(counts[2] / 10_000 - 2.25 ** 2) < 0.25 and abs(counts[0] / 10_000 - (1 - 0.1054)) < 0.02
    assert sorted(map(str, mixing.mix(d, {"a": 0.75}).collect())) == sorted(map(str, mixing.mix(d.repartition(7), {"a": 0.75}).collect()))


def test_mixing_edges(docs):
    out = mixing.mix(docs, {"hot": 0.5})
    assert set(docs.columns) <= set(out.columns)
    assert out.where("copy > n_copies or copy < 1").count() == 0


def test_quality_keeps_columns(docs):
    out = quality.clean(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    assert out.where("doc_id in (1, 2, 3, 4)").where("kept or not base_failed").count() == 0
    assert out.where("doc_id = 10 and kept").count() == 1


def plain_quality(texts):
    """(base_failed, kept, text without failing lines) of each text, by counting lines and contexts in dicts."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [[" ".join(words(x)) for x in (t or "").split("\n") if len(words(x)) >= 4] for t in texts]
    key = lambda line: quality.line_key(line.encode().split())
    seen: dict = {}
    for own in lines:
        for x in set(own):
            others = [key(y) for y in set(own) if y != x]
            if others:
                seen.setdefault(x, []).append(min(others))
    boilerplate = {x for x, c in seen.items() if len(set(c)) >= 10 and 2 * len(set(c)) >= len(c)}

    def fails(line, whole):
        w = words(line)
        text = line.strip()
        return len(w) >= 4 and bool(
            " ".join(w) in boilerplate or 100 * sum(c in "#*$%&|<>" for c in line) > 8 * len(line.encode()) or 100 * line.count("!!") > 30 * len(w)
            or quality.SENTENCE_END.search(whole) and not quality.ends_well(text) and not quality.SENTENCE_END.search(text)
            or 4 * sum(len(x) <= 3 and not re.search(r"\w", x) for x in w) > len(w) or len(w) >= 8 and 2 * max(w.count(x) for x in w) > len(w))

    out = []
    for t in texts:
        w = words(t or "")
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        lost = sum(len(words(x)) for x in (t or "").split("\n") if fails(x, t))
        rest = "\n".join(x for x in (t or "").split("\n") if not fails(x, t))
        out.append((base, not base and 2 * lost <= len(w), rest))
    return out


def test_quality_against_plain_version(spark, monkeypatch):
    """Verdicts, with mined boilerplate: a notice of many pages, a family of copies that shares its lines, junk."""
    r = random.Random(8)
    line = lambda n: " ".join(r.choice(VOCAB) for _ in range(n)).capitalize() + "."
    notice = "\n".join(line(20) for _ in range(2))
    family = [line(15) for _ in range(6)]
    texts = [None, "", " \n", line(49), line(50), "x " * 5000 + "."]
    texts += [f"{line(25)}\n{notice}\n{line(20)}" for _ in range(12)] + [f"{notice}\n{line(12)}\nshort one" for _ in range(12)]
    texts += ["\n".join([*family[:i % 6], line(15), *family[i % 6 + 1:]]) for i in range(30)]
    texts += [f"{line(40)}\n" + " | ".join(words(60)), f"{line(60)}\n" + " | ".join(words(20)), " ".join(words(80)), f"{line(60)}\n" + "$$$ ".join(words(50))]
    d = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    want = [x[:2] for x in plain_quality(texts)]
    assert len(set(want)) == 3 and quality.mine_lines(d).count() == 2
    for most in (quality.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality, "BROADCAST_LINES", most)
        got = {x.doc_id: (x.base_failed, x.kept) for x in quality.digest(d).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert quality.clean(d.union(d)).where("keep_id = 'k'").count() == 2 * len(texts)


def test_packing_whole(docs):
    out = packing.pack(docs, capacity=128).collect()
    assert sorted(out) == sorted(packing.pack(docs.repartition(3), capacity=128).collect())
    encode = tokens.counter(tokens.vocabulary()).tokenizer.encode
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(encode(r.text or "", add_special_tokens=False).ids)
    got: dict = {}
    bins: dict = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert got == {k: v for k, v in want.items() if v}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= 128 and len({r.source for r in b}) == len(b) == len({r.cluster for r in b})


def plain_pack(rows, capacity):
    """(id, piece) of the bins of one shard, as a sorted list: (id, source, size, cluster) rows packed by looking at every bin."""
    pieces = []
    for d, source, size, cluster in rows:
        pieces += [(min(capacity, size - k * capacity), d, k, source, cluster) for k in range(-(-size // capacity))]
    bins = []
    for size, d, k, source, cluster in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        fits = [b for b in bins if b["room"] >= size and source not in b["source"] and cluster not in b["cluster"]]
        if not fits:
            bins.append({"room": capacity, "source": set(), "cluster": set(), "held": []})
            fits = bins[-1:]
        b = min(fits, key=lambda b: b["room"])
        b["room"] -= size
        b["source"].add(source), b["cluster"].add(cluster), b["held"].append((d, k))
    return sorted(sorted(b["held"]) for b in bins)


def test_packing_against_plain_version(spark):
    """One shard; sizes are told, so bins hold what the plain version's bins hold."""
    r = random.Random(3)
    rows = [(i, f"s{r.randrange(30)}", r.choice([0, 1, 7, 30, 64, 65, 300, r.randrange(128)]), f"c{r.randrange(90)}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n int, c string").withColumn("text", F.lit(None).cast("string"))
    assert bins_of(packing.pack(d, size=F.col("n"), cluster=F.col("c"), capacity=128)) == plain_pack(rows, 128)


def bins_of(packed):
    bins: dict = {}
    for x in packed.collect():
        bins.setdefault(x.bin_id, []).append((x.doc_id, x.piece))
    return sorted(map(sorted, bins.values()))


def test_tokens_rows(docs, monkeypatch):
    whole = sorted(map(str, tokens.count_tokens(docs).collect()))
    monkeypatch.setattr(tokens, "COMMON", 3)  # nearly all words are joined by shuffle
    assert sorted(map(str, tokens.count_tokens(docs).collect())) == whole
    out = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    c = tokens.counter(tokens.vocabulary())
    for i, t in TEXTS.items():
        n = len(c.tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 2048)


PAGES = [
    (1, "http://a.Example.com/en/1?x", "<p>a"), (2, "https://www.example.com/en/", None), (3, "https://x.net/es/1", ""), (4, None, "<p>b"), (5, "no scheme", "x"),
    (6, "http://EXAMPLE.com", "y"), (None, "http://b.org/#t", "z"), (7, "http://notexample.com/en/1", "<p>c"), (7, "http://notexample.com/en/1", "<p>c"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, text string")


def test_url_rules(spark):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages_of(spark, PAGES), labels).collect()}
    assert got == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("x.net", "/es/1", "net/es/", "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("example.com", "", None, "allow"), None: ("b.org", "/", None, "allow"), 7: ("notexample.com", "/en/1", "com/", "allow")}


def test_url_mining(spark):
    rows = [(i, f"https://{'spam' if i % 4 == 0 else 'news'}.example.org/{'win' if i % 2 else 'read'}/{i}", "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages_of(spark, rows), labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i in range(400) if i % 4 == 0}


@pytest.mark.parametrize("seed", range(3))
def test_url_mining_against_every_token_set(spark, seed):
    """Rules from all sets of tokens, counted one by one, and the DuckDB twin; some token pairs go with bad labels."""
    import itertools

    import duckdb
    import pandas as pd

    r = random.Random(seed)
    rows, labels = [], []
    for i in range(500):
        path = sorted(r.sample("buy now free news read more sport art".split(), r.randint(0, 4)))
        rows.append((i, r.choice([None, "x"] + ["https://a%d.example.org/%s/%d" % (r.randrange(4), "/".join(path), i)] * 20), ""))
        likely = 0.9 if {"buy", "now"} <= set(path) else 0.7 if "free" in path else 0.1
        labels.append((i if r.random() < 0.8 else None, int(r.random() > likely), 0))
    bad = {d: q == 0 for d, q, _ in labels if d is not None}
    def items(url):
        if not url or "://" not in url:
            return frozenset()
        host, _, rest = url.split("://")[1].partition("/")
        return frozenset([f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in re.split("[^a-z0-9]+", rest) if x and not x.isdigit()])
    known = [(items(u), bad[i]) for i, u, _ in rows if i in bad and (bad[i] or items(u))]
    least = math.ceil(min(1.0, max(url_filter.MIN_SUPPORT, url_filter.MIN_ROWS / len(known))) * len(known))
    counts: dict = {}
    for own, b in known:
        for k in range(1, len(own) + 1):
            for c in itertools.combinations(sorted(own), k):
                n = counts.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += b
    base = sum(b for _, b in known) / len(known)
    found = [set(c) for c, (n, b) in counts.items() if b >= least and b / n >= url_filter.MIN_CONFIDENCE and b / n / base >= url_filter.MIN_LIFT]
    want = {i: "block" if any(c <= items(u) for c in found) else "allow" for i, u, _ in rows}
    assert set(want.values()) == {"allow", "block"}
    pages, known_labels = pages_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, known_labels).collect()
    assert {x.page_id: x.verdict for x in got} == want
    con = duckdb.connect()
    con.register("p", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    con.register("l", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    con.execute("CREATE VIEW pages AS SELECT page_id, url FROM p")
    con.execute("CREATE VIEW labels AS SELECT doc_id::BIGINT AS doc_id, quality, toxic FROM l")
    twin = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE})").fetchall()
    assert sorted(map(str, twin)) == sorted(str((x.page_id, x.host, x.path, x.rule, x.verdict)) for x in got)


def test_url_mining_sees_late_tokens(spark):
    """The bad token is the 31st of its url; the 30 before it stand on all urls, which as single items would make 2 ** 30 itemsets."""
    path = "/".join(f"{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xy'[i // 26]}" for i in range(27))
    rows = [(i, f"https://a.example.org/{path}/{'spam' if i % 4 == 0 else 'news'}{'/win' if i % 2 else ''}", "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages_of(spark, rows), labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i in range(400) if i % 4 == 0}


def test_html_template(spark):
    rows = [(i, f"http://h.example.org/{i}", f"<div class=x><p>Subscribe for more</p><p>Story {i} of the day</p></div>") for i in range(20)]
    rows += [(50 + i, "http://copy.example.org/", "<div><p>One and the same text</p></div>") for i in range(20)] + PAGES
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert got[3] == ("", 0) and got[19][0] == "Story 19 of the day"
    assert got[50][0] == "One and the same text"


def test_html_blank_page_is_no_reference(spark):
    rows = [(i, f"http://h.example.org/{i}", f"<div class=x><p>Subscribe for more</p><p>Story {i} of the day</p></div>") for i in range(60)]
    pages = pages_of(spark, rows)
    got = html_extract.extract(pages.union(pages_of(spark, [(99, "http://h.example.org/", None), (98, "http://h.example.org/", " <p> ")]))).collect()
    assert all(r.text == ("" if r.page_id > 97 else f"Story {r.page_id} of the day") for r in got)


def plain_extract(rows):
    """Pages of one host, one by one: references, plain recursive matching and counts in dicts."""
    from collections import Counter

    def kids(o, n):
        return [k for k, p in enumerate(o.up) if p == n]

    def match(a, b, i, j):
        if a.label[i] != b.label[j]:
            return 0, []
        x, y = kids(a, i), kids(b, j)
        t = [[(0, [])] * (len(y) + 1) for _ in range(len(x) + 1)]
        for u, p in enumerate(x):
            for v, q in enumerate(y):
                n, pairs = match(a, b, p, q)
                t[u + 1][v + 1] = max(t[u][v + 1], t[u + 1][v], (t[u][v][0] + n, t[u][v][1] + pairs), key=lambda c: c[0])
        return 1 + t[-1][-1][0], [(i, j), *t[-1][-1][1]]

    seen = [(i, h, html_extract.Outline(html_extract.parse(h or ""))) for i, _, h in rows]
    full = [x for x in seen if not x[2].blank]
    sizes = sorted(Counter(o.layout for _, _, o in full).items(), key=lambda c: (-c[1], c[0]))
    refs = [lay for r, (lay, n) in enumerate(sizes) if r == 0 or r < html_extract.LAYOUTS and n >= html_extract.SAME_PAGES]
    ref = {lay: min((html_extract.digest(h), i) for i, h, o in full if o.layout == lay)[1] for lay in refs}
    tree = {i: o for i, _, o in full}

    def keys(o):
        lay = o.layout if o.layout in ref else refs[0]
        partner = dict(match(o, tree[ref[lay]], 0, 0)[1])
        path = [o.label[0]]
        for n in range(1, len(o.label)):
            path.append(path[o.up[n]] + "/" + o.label[n])
        return lay, [partner.get(n, path[n]) for n in range(len(o.label))]

    pages, values = Counter(), {}
    for o in {o.sig: o for _, _, o in full}.values():
        lay, ks = keys(o)
        pages[lay] += 1
        for k, h in zip(ks, o.hashes):
            if h is not None:
                values.setdefault((lay, k), Counter())[h] += 1
    out = {}
    for i, h, o in seen:
        fixed = set()
        if not o.blank:
            lay, ks = keys(o)
            for n, (k, h2) in enumerate(zip(ks, o.hashes)):
                if h2 is not None:
                    (top, times), every = values[lay, k].most_common(1)[0], sum(values[lay, k].values())
                    if top == h2 and times >= html_extract.SAME_PAGES and times >= html_extract.SAME_SHARE * every and every >= html_extract.LAYOUT_SHARE * pages[lay]:
                        fixed.add(n)
        # fold once more: text_of looks at the numbers that the outline left in the tree
        root = html_extract.parse(h or "")
        html_extract.Outline(root)
        out[i] = html_extract.text_of(root, fixed)
    return out


def plain_pages(host, base, n=40):
    """Pages without any telling tag or class: two layouts, an optional block, template and story side by side."""
    r = random.Random(base)
    rows = []
    for i in range(n):
        story = "".join(f"<div>Story {base + i} part {k} {r.random()}</div>" for k in range(r.randint(1, 9)))
        menu = "<div><div>Home of all</div><div>Contact us</div></div>"
        extra = "<section><div>Win a prize now</div></section>" if i % 2 else ""
        body = f"<div>{menu}{extra}<div>{story}</div><div>All about us</div></div>" if i % 3 else f"<table><tr><td>Old menu</td><td>{story}</td></tr></table><p>Made by hand</p>"
        rows.append((base + i, f"http://{host}/{i}", f"<html><body>{body}</body></html>"))
    return rows


def test_html_against_plain_version(spark):
    """Wrapper induction alone tells template from story, as in the plain version."""
    hosts = [plain_pages("a.org", 1000), plain_pages("b.org", 2000), plain_pages("few.org", 3000, 5), [(4000, "http://c.org/", None), (4001, "http://c.org/", "<p>x")]]
    got = {r.page_id: r.text for r in html_extract.extract(pages_of(spark, [p for h in hosts for p in h])).collect()}
    want: dict = {}
    for h in hosts:
        want |= plain_extract(h)
    assert got == want
    for i in range(40):  # only stories are left
        assert got[1000 + i] and all(line.startswith(f"Story {1000 + i} ") for line in got[1000 + i].split("\n")), got[1000 + i]
    assert got[3001].startswith("Home of all")


def test_html_hard_pages(spark):
    """Pages that are cut, deep, wide or large stop nothing."""
    hard = ["<p>a</p><div " + " ".join(f'a{i}="v"' for i in range(5000)), "<div>" * 5000 + "deep", "<p>x <b>y</b></p>" * 10_000, "<div>" + "word " * 1_000_000, "<a b=\"" * 5000]
    rows = [(i, "http://h.org/", hard[i % 5] + f"<p>{i}") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert len(got) == 20 and got[1] == "deep\n1" and len(got[3]) > 4_900_000


def test_warc_audit(spark):
    rows = [(i, f"http://a/{i}", "<p>é" * (i % 90)) for i in range(1500)] + PAGES[1:2] + [(None, None, None)] * 2
    recs = warc.records(pages_of(spark, rows))
    assert warc.audit(warc.manifest(recs), warc.manifest(recs)).count() == 0
    got = {(r.page_id, r.status) for r in warc.audit(warc.manifest(recs), warc.manifest(warc.rot(recs))).collect()}
    assert got == {(i, "damaged") for i in range(1500) if i % 37 == 5} | {(i, "missing") for i in range(1500) if i % 37 == 11}
    back = {(r.page_id, r.status) for r in warc.audit(warc.manifest(warc.rot(recs)), warc.manifest(recs)).collect()}
    assert {s for _, s in back} == {"damaged", "extra"}
    anew = warc.audit(warc.manifest(recs), warc.manifest(warc.rot(recs).where("record is not null")))
    assert {(r.page_id, r.status) for r in anew.collect()} == got and anew.count() == len(got)
    r = recs.where("page_id = 3").first()
    assert int(r.record.split("Content-Length: ")[1].split("\r\n")[0]) == len(("<p>é" * 3).encode())


def test_warc_repeated_and_null_ids(spark):
    rows = [(None, "u", "same")] * 5 + [(7, "u", "x")] * 3 + [(7, "u", "y")]
    few = warc.records(pages_of(spark, rows), per_file=2)
    assert few.where("page_id is null").select("file").distinct().count() == 3
    less = warc.records(pages_of(spark, rows[1:6] + rows[8:]), per_file=2)
    got = sorted(str((r.page_id, r.status)) for r in warc.audit(warc.manifest(few), warc.manifest(less)).collect())
    assert got == ["(7, 'missing')", "(7, 'missing')", "(None, 'missing')"]


def test_warc_files(spark, tmp_path):
    """What is written lies where the manifest says, and reads back as it was."""
    rows = [(i, f"http://a/{i}", "\r\n\r\nWARC/1.0\r\né" * (i % 50)) for i in range(1200)] + [(None, None, None)] * 2 + [(3, "http://a/3", "again")]
    recs = warc.records(pages_of(spark, rows))
    warc.write(recs, f"{tmp_path}/warc")
    back = warc.read(spark, f"{tmp_path}/warc")
    place = ["file", "offset", "length", "page_id", "digest"]
    assert sorted(map(str, back.select(place).collect())) == sorted(map(str, warc.manifest(recs).select(place).collect()))
    assert back.count() == len(rows)
    assert warc.audit(warc.manifest(recs), back).count() == 0
    assert {(r.page_id, r.html) for r in back.collect()} == {(i, h or "") for i, _, h in rows}


def plain_pipeline(rows):
    """The bins of the whole pipeline, in one process: (id, text, source) rows through all five stages."""
    cleaned = plain_quality([t for _, t, _ in rows])
    rows = [(d, rest, s) for (d, _, s), (_, kept, rest) in zip(rows, cleaned) if kept]
    best: dict = {}
    for d, t, s in rows:
        k = "".join(t.split())
        best[k] = min(best.get(k, (0, d, t, s)), (-len(t), d, t, s))
    rows = sorted((d, t, s) for _, d, t, s in best.values())
    names = {d: c for d, _, c in plain_components([(d, t) for d, t, _ in rows])}
    rows = [x for x in rows if names[x[0]] == x[0]]
    mass: dict = {}
    for _, t, s in rows:
        mass[s] = mass.get(s, 0) + len(t)
    listed = {s: w for s, w in mixing.WEIGHTS.items() if s in mass}
    copies = []
    for d, t, s in rows:
        share = listed.get(s, (1 - sum(mixing.WEIGHTS.values())) / max(1, len(mass) - len(listed)))
        rate = share * sum(mass.values()) / mass[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{d}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        n, term = 0, math.exp(-rate)
        cdf = term
        while u >= cdf:
            n += 1
            term *= rate / n
            cdf += term
        copies += [(d, t, s)] * n
    encode = tokens.counter(tokens.vocabulary()).tokenizer.encode
    sized = [(d, s, len(encode(t, add_special_tokens=False).ids), "".join(t.split())) for d, t, s in copies]
    return plain_pack(sized, packing.CAPACITY)


@pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="no pipeline")
def test_pipeline(spark, tmp_path):
    """run() against the plain version, and each stage's columns and decisions."""
    import corpus_pipeline

    names = "doc_id text lang source n_chars".split()
    r = random.Random(12)
    prose = [[r.choice(VOCAB) for _ in range(90)] for _ in range(60)]
    notice = "This notice stands below very many stories."
    rows = [(i, " ".join(p), "en", f"src{i % 4}", 0) for i, p in enumerate(prose)]
    rows += [(100, "  ".join(prose[0]), "en", "src0", 0), (101, " ".join(prose[1][:-1]), "en", "src1", 0), (102, "junk", "en", "src0", 0), (103, None, "en", None, 0)]
    rows += [(200 + i, " ".join(r.choice(VOCAB) for _ in range(300 * (i % 9) + 60)) + f".\n{notice}", "en", f"src{i % 5}", 0) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage)[2] == "n-gram Jaccard join" and len(stage) == 5
    a = stage["quality rules"](spark, d, str(tmp_path))
    assert a.columns == names and {x.doc_id for x in a.collect()} == {*range(60), 100, 101, *range(200, 230)}
    assert a.where(F.col("text").contains("notice")).count() == 0
    b = stage["exact dedup"](spark, a, str(tmp_path))
    assert b.columns == names and {x.doc_id for x in b.collect()} == {*range(1, 60), 100, 101, *range(200, 230)}
    c = stage["n-gram Jaccard join"](spark, b, str(tmp_path))
    assert c.columns == names and {x.doc_id for x in c.collect()} == {*range(1, 60), 100, *range(200, 230)}
    assert stage["mixing to target weights"](spark, c, str(tmp_path)).columns == names
    assert bins_of(corpus_pipeline.run(spark, str(tmp_path))) == plain_pipeline([(i, t, s) for i, t, _, s, _ in rows])
