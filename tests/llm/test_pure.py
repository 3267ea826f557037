"""Parts of the corpus operators that need no Spark, against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkforge.llm import html_extract as H
from linkforge.llm import jaccard, packing, quality, suffix_dedup, tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounter(tokens.vocabulary())


@given(text=st.text(max_size=80))
@settings(deadline=None, max_examples=300)
def test_tokens_equal_library(counter, text):
    for t in (text, text + "<|endoftext|>" + text.upper(), "it's <|startoftext|>'S " + text):
        assert counter.count(t) == len(counter.tokenizer.encode(t, add_special_tokens=False).ids)


def test_tokens_every_character(counter):
    every = [chr(i) for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    for i in range(0, len(every), 2000):
        t = "x".join(every[i:i + 2000]) + " ".join(every[i:i + 2000:3])
        assert counter.count(t) == len(counter.tokenizer.encode(t, add_special_tokens=False).ids)


@given(st.lists(st.sampled_from(["a", "b", "A b", "\n", " ", "c\n", "d|", "é"]), max_size=40))
@settings(deadline=None)
def test_quality_counts(parts):
    t = " ".join(parts)
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.split()]
    m = quality.measure(t)
    assert m[:5] == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_quality_lines():
    good = "The river ran past the old mill and the children played on its banks until the evening came."
    assert quality.measure(good)[5] == 0
    for bad in ("a$$$ b### c%%% d&&& e***", "home | news | sport | about | contact", "BUY!! NOW!! BEST!! PRICE!!", " ".join(["spam."] * 20),
                "Home › News › Sport › About.", "a » b · c – d."):
        assert quality.measure(bad)[5] == len(bad.split()), bad
    assert quality.measure("one line of words that never comes to an end")[5] == 0
    assert quality.measure("It rained.\none line of words that never comes to an end")[5] == 10
    for fine in ("A heading alone", "He said: “It was late.” Then he", "Was it late?", "这 是 一 句 话。", "a line (with a bracket)"):
        assert quality.measure(fine)[5] == 0, fine
    assert quality.measure(good, {quality.line_key(good.encode().split())})[5] == len(good.split())
    long = "No line is too long to be judged. " * 40
    assert quality.measure(long, {quality.line_key(long.encode().split())})[5] == len(long.split())
    assert quality.measure(None)[:6] == (0, 0, 0, 0, 0, 0)


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 3)), max_size=30))
def test_packing_is_best_fit(pieces):
    pieces = sorted(pieces, reverse=True)
    placed = packing.best_fit(pieces, 20)
    bins: list[dict] = []
    for (size, s, c), (b, start) in zip(pieces, placed, strict=True):
        fits = [(20 - x["used"], i) for i, x in enumerate(bins) if x["used"] + size <= 20 and s not in x["s"] and c not in x["c"]]
        want = min(fits)[1] if fits else len(bins)
        assert b == want
        if b == len(bins):
            bins.append({"used": 0, "s": set(), "c": set()})
        assert start == bins[b]["used"]
        bins[b]["used"] += size
        bins[b]["s"].add(s), bins[b]["c"].add(c)


def brute_repeats(texts, span=200):
    seen: dict = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - span + 1):
            seen.setdefault(t[p:p + span], []).append((i, p))
    return {x for v in seen.values() if len(v) > 1 for x in v}


@pytest.mark.parametrize("seed", range(6))
def test_columns_find_repeats(seed):
    """Aligned stretches: a window repeats if its bytes stand at the same column of another stretch."""
    r = random.Random(seed)
    base = bytes(r.choice(b"ab") for _ in range(suffix_dedup.WIDTH))
    starts, raws = [], []
    for _ in range(30):
        lo = r.randint(0, 150)
        hi = r.randint(lo, 150) + 200
        raw = bytearray(base[lo:hi])
        if r.random() < 0.6:
            raw[r.randrange(len(raw))] ^= 1
        starts.append(lo), raws.append(bytes(raw))
    hit = suffix_dedup.build_columns(np.array(starts), raws)
    for i in range(30):
        for c in range(suffix_dedup.STARTS):
            own = starts[i] <= c and c + 200 <= starts[i] + len(raws[i])
            window = raws[i][c - starts[i]:c - starts[i] + 200] if own else None
            other = own and any(j != i and starts[j] <= c and raws[j][c - starts[j]:c - starts[j] + 200] == window for j in range(30))
            assert hit[i, c] == bool(other), (i, c)


def test_anchors_partition_windows():
    r = random.Random(1)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 199, 200, 201, 900)] + [b"x" * 700]
    text, a, x, lo, w, d = suffix_dedup.anchors(texts)
    got = {}
    for i in range(len(text)):
        for p in range(lo[i], lo[i] + w[i]):
            assert (text[i], p) not in got
            got[text[i], p] = a[i], lo[i] + d[i] - p
    assert set(got) == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 199)}
    by = {}
    for (i, p), v in got.items():
        assert by.setdefault(texts[i][p:p + 200], v) == v


def test_spans_merge():
    assert suffix_dedup.remove(b"abcdefgh", [(2, 4), (0, 1), (4, 6), (3, 5)]) == (b"bgh", [(0, 1), (2, 6)])
    assert suffix_dedup.remove(b"", []) == (b"", [])


def test_shingles():
    assert len(jaccard.shingle_set(None)) == len(jaccard.shingle_set(" \n")) == 0
    assert len(jaccard.shingle_set("One two")) == 1 and (jaccard.shingle_set("One two") == jaccard.shingle_set("one\ttwo")).all()
    assert len(jaccard.shingle_set("a b c d e f")) == 2
    assert (jaccard.shingle_set("É a b c d") != jaccard.shingle_set("é a b c d")).all()


@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60))
def test_prefix_bound(n, m, o):
    """The count that qualified() asks for never exceeds what two linked sets share in their prefixes."""
    o = min(o, n, m)
    if 100 * o < 80 * (n + m - o):
        return
    a = list(range(o)) + [1000 + i for i in range(n - o)]
    b = list(range(o)) + [2000 + i for i in range(m - o)]
    r = random.Random(n * m + o)
    rank = {t: r.random() for t in a + b}
    pa, pb = (sorted(s, key=rank.get)[:jaccard.prefix_size(len(s))] for s in (a, b))
    both = -(-80 * (n + m) // 180)
    assert len(set(pa) & set(pb)) >= both - jaccard.needed(max(n, m)) + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<header class=masthead>Site</header><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One
 two.<br><p>Three &lt;four&gt; &eacute;<div class="share-box">Tweet</div><ul><li>x<li>y</ul><section class="comments"><p>First!</section></article>
<aside>Side</aside><form>Mail</form><footer>&copy; us</footer>"""


def extract(page, template=frozenset()):
    return H.text_of(H.parse(page), set(template))


def test_html():
    assert extract(PAGE) == "Head & tail\nOne two.\nThree <four> é\nx\ny"
    assert extract("") == extract("<p>") == extract("<!-- <p>x</p>") == ""
    assert extract("<div>a<span>b</span> c</div>d") == "ab c\nd"
    assert extract("<p hidden>a</p><p>b") == "b"
    assert extract("x < y <b>z</b>") == "x < y z"
    assert extract("<main><p>m</p></main><p>n") == "m"


def test_html_marks_are_evidence():
    assert extract('<div class="page no-sidebar"><p>a</p></div>') == extract('<div class="menu-open"><p>a</p></div>') == "a"
    assert extract('<div class="content-sidebar"><article><p>a</p></article><div class="sidebar">s</div></div>') == "a"
    assert extract('<article><p>a</p><p class="notice">b</p><div class="comments">c</div></article>') == "a\nb"
    assert extract('<form><p>a long text</p></form><div class="notice">n</div><p>b</p>') == "a long text\nb"
    assert extract("<article><h2>x</h2><p>teaser, a long one</p></article><article><h1>t</h1><p>a</p></article>") == "t\na"


def test_html_broken_tags():
    assert extract('<p>a</p><div class="x') == extract("<p>a</p><b") == extract("<p>a<!-- b") == "a"
    assert extract('<a title="x>y">z</a>') == extract("<div class='a\"b'>z</div>") == extract("<!-->z<!--->") == "z"
    assert extract("</b c='d>'>x</p>") == "x"
    assert extract("<ul><li>a<ul><li>b</ul><li>c</ul>d") == "a\nb\nc\nd"


def timed(page):
    import time
    start = time.process_time()
    root = H.parse(page)
    H.text_of(root), H.Outline(root)
    return time.process_time() - start


@pytest.mark.parametrize("page", [
    "<p>a</p><div " + " ".join(f'a{i}="v"' for i in range(100_000)), "<div>" * 50_000 + "x", "<div>" * 5_000 + "<p>a</p>" * 50_000,
    "<span><article>" + "<div>" * 5_000 + "</span>" * 100_000, '<div class="' + "a " * 500_000 + '">x</div>', '<a b="x>' * 100_000,
    "<" * 1_000_000, "<a " * 500_000, "<!-- " * 300_000, "<ul>" + "<li>a <b>c</b>" * 60_000])
def test_html_reading_is_linear(page):
    assert timed(page) < 15


def test_html_matching_is_bounded():
    r = random.Random(2)
    many = ["".join(f"<{r.choice(['p', 'div', 'ul', 'h2'])}>{f'<{k}>x</{k}>' * r.randint(0, 9)}" for _ in range(10_000)) for k in "bi"]
    deep = ["<div>" * 5_000 + "<p>x", "<div>" * 4_990 + "<p>y<p>z"]
    for pages in (many, deep):
        a, b = (H.Outline(H.parse(p)) for p in pages)
        assert len(H.Aligner().partners((a.label, a.up), (b.label, b.up))) == len(a.label)


@given(st.text("<>/pab &;!-\"'=\n", max_size=60))
@settings(deadline=None)
def test_html_never_fails(s):
    extract(s)


def plain_match(a, b, i=0, j=0):
    """Simple tree matching of two outlines by plain recursion."""
    if a.label[i] != b.label[j]:
        return 0
    x, y = ([k for k, p in enumerate(o.up) if p == n] for o, n in ((a, i), (b, j)))
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for u, p in enumerate(x):
        for v, q in enumerate(y):
            t[u + 1][v + 1] = max(t[u][v + 1], t[u + 1][v], t[u][v] + plain_match(a, b, p, q))
    return 1 + t[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_tree_matching(seed):
    r = random.Random(seed)
    def tree(depth):
        return "".join(f"<{(g := r.choice(['div', 'span', 'ul']))}>{tree(depth - 1) if depth else ''}</{g}>" for _ in range(r.randint(0, 3)))
    a, b = (H.Outline(H.parse(tree(3))) for _ in range(2))
    partner = H.Aligner().partners((a.label, a.up), (b.label, b.up))
    found = [(x, y) for x, y in enumerate(partner) if y >= 0]
    assert len(found) == plain_match(a, b) == len({y for _, y in found})
    for x, y in found:
        assert a.label[x] == b.label[y] and (x == 0 or partner[a.up[x]] == b.up[y])


def test_outline_folds_long_lists():
    o = H.Outline(H.parse("<ul>" + "".join(f"<li>{i}" for i in range(1000)) + "</ul><x-a></x-a><x-b></x-b>"))
    assert o.label.count("li") == 2 * H.ENDS[0] + 1 and o.label.count("#other") == 2
    o = H.Outline(H.parse("".join(f"<div>{'<p><b>x</b></p>' * 40}</div>" for _ in range(40))))
    assert len(o.label) <= H.MOST_NODES
