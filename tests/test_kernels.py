"""Similarity kernels and decoder arithmetic against hand-made values and brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkforge.functions import similarity as S
from linkforge.operators.decode import best_prefix, poisson_binomial

word = st.text("abc ", max_size=9)


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(word, word)
@settings(deadline=None)
def test_lcs(a, b):
    assert S.lcs(a, b) == plain_lcs(a, b)


@given(word, word)
@settings(deadline=None)
def test_partial_is_best_window(a, b):
    if not a or not b:
        assert S.partial(a, b) == (100.0 if a == b else 0.0)
        return
    def best(short, long):
        n = len(short)
        cuts = {long[max(0, e - n):min(e, len(long))] for e in range(1, len(long) + n)}
        return max(200.0 * plain_lcs(short, c) / (n + len(c)) for c in cuts)
    want = max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))
    assert S.partial(a, b) == pytest.approx(want)


def test_known_values():
    assert S.ratio("", "") == 100
    assert S.ratio("abcd", "abxd") == 75
    assert S.token_sort("b a", "a b") == 100
    assert S.token_set("new york mets", "new york mets vs braves") == 100
    assert S.token_set("", "a") == 0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler("", "") == 1 and S.jaro_winkler("", "a") == 0
    assert S.partial("abc", "xxabcxx") == 100


@pytest.mark.parametrize("seed", range(20))
def test_best_prefix_is_brute_force(seed):
    r = random.Random(seed)
    p = np.array(sorted((r.random() for _ in range(r.randint(0, 7))), reverse=True))
    value = []
    for k in range(len(p) + 1):
        e = 0.0
        for bits in itertools.product((0, 1), repeat=len(p)):
            prob = np.prod([x if b else 1 - x for b, x in zip(bits, p)])
            tp, true = sum(bits[:k]), sum(bits)
            e += prob * (1.0 if not k and not true else 1.25 * tp / (0.25 * true + k) if k else 0.0)
        value.append(e)
    k, best = best_prefix(p)
    assert best == pytest.approx(max(value)) and value[k] == pytest.approx(max(value))


def test_poisson_binomial_sums_to_one():
    d = poisson_binomial(np.array([0.2, 0.5, 0.9]))
    assert d.sum() == pytest.approx(1) and d[3] == pytest.approx(0.09)


def test_rules_of_many_countries(spark):
    """One table holds the rules of all countries: the plan grows with their number only once."""
    import time

    from pyspark.sql import functions as F

    from linkforge.operators import rules

    maps = {"nm": {f"a{i}": f"b{i} c" for i in range(900)}, "addr": {"street": "st"},
            "by_country": {f"C{k}": {"nm": {"c": f"land {k}", **{f"x{i}": f"y{i}" for i in range(30)}}, "addr": {"st": f"st{k}"}} for k in range(30)}}
    rows = [(k, f"C{k}" if k < 30 else None, f"a{k} x3 zz", "9 street", 0) for k in range(40)]
    d = spark.createDataFrame(rows, "id long, country string, nm string, addr string, indic int")
    start = time.time()
    got = {r.id: (r.nm, r.addr) for r in rules.rewrite(d, maps).collect()}
    assert time.time() - start < 60
    assert got == {k: (f"b{k} land {k} y3 zz", f"9 st{k}") if k < 30 else (f"b{k} c x3 zz", "9 st") for k in range(40)}
    assert rules.rewrite(d, {"nm": {}, "addr": {}, "by_country": {}}).where(F.col("nm") != F.concat(F.lit("a"), F.col("id"), F.lit(" x3 zz"))).count() == 0


def test_too_many_rules_are_refused(spark):
    from linkforge.operators import rules

    many = spark.range(rules.MOST_RULES + 1).selectExpr("'all' scope", "'' country", "'nm' field", "cast(id as string) x", "'y' y")
    with pytest.raises(ValueError):
        rules.as_maps(many)
