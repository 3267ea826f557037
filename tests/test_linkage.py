"""Normalisation edge values, sets, rules, decoding and a whole run over a small problem."""

import pytest
from pyspark.sql import functions as F

from linkforge.functions import text
from linkforge.operators import decode, rules, sampling, shift
from linkforge.plans.linkage import Linkage
from linkforge.config import LinkConfig
from linkforge.sources import tables


def normal(spark, name=None, addr=None):
    df = spark.createDataFrame([("S1-1", "X", name, addr)], "id string, country string, raw_name string, raw_addr string")
    return text.normalise(df).first()


@pytest.mark.parametrize("name, nm, core, legal", [
    ("The Acme Co. Ltd", "the acme co ltd", "acme", "co ltd"),
    ("Limited Company", "limited company", "limited company", "co ltd"),
    ("l.l.c. Smith & Sons", "llc smith and sons", "smith sons", "llc"),
    ("www.juarez-swaim.com", "juarez swaim", "juarez swaim", ""),
    ("#shahdara O'Neil", "shahdara oneil", "shahdara oneil", ""),
    ("Café Größe", "cafe grosse", "cafe grosse", ""),
    ("", "", "", ""), (None, "", "", ""),
])
def test_names(spark, name, nm, core, legal):
    r = normal(spark, name, "")
    assert (r.nm, r.core, r.legal) == (nm, core, legal)


@pytest.mark.parametrize("addr, want, nums, lm", [
    ("0013000 5th Ave.", "13000 5 avenue", "13000 5", 0), ("<NULL>", "", "", 0), (None, "", "", 0), ("N° 12 Near St", "12 near street", "12", 1),
    ("#7, Unit 000", "7 0", "7 0", 0),
])
def test_addresses(spark, addr, want, nums, lm):
    r = normal(spark, "x", addr)
    assert (r.addr, r.nums, r.lm) == (want, nums, lm)


def test_other_scripts(spark):
    r = normal(spark, "प्राइवेट लिमिटेड", "")
    assert r.indic == 1 and r.nm.split() == ["praivet", "limited"]


def test_shift_boundaries(spark):
    d = spark.createDataFrame([("q", f"t{i}", 0.4) for i in range(8)], "q string, t string, p double")
    n = spark.createDataFrame([("q", "1000")] + [(f"t{i}", v) for i, v in enumerate(["1010", "1011", "1050", "1051", "1500", "1501", "9" * 30, "000"])], "id string, n string")
    got = {r.t: r.cat for r in shift.categories(d, n).collect()}
    assert [got[f"t{i}"] for i in range(8)] == ["d10_false", "d50_false", "d50_false", "d500_false", "d500_false", "dbig_false", "dbig_false", "base_false"]


def test_shift_by_country_is_shift_of_each(spark):
    import random

    r = random.Random(4)
    cats = ["base_true", "d10_true", "d50_false", "dbig_true"]
    rows = [(c, f"{c}q{i}", f"{c}t{i}_{k}", r.random(), r.choice(cats)) for c in "AB" for i in range(60) for k in range(3)]
    d = spark.createDataFrame(rows, "country string, q string, t string, p double, cat string")
    goal = {(c, cat): 0.1 * (i + 1) for i, (c, cat) in enumerate((c, cat) for c in "AB" for cat in cats[:3])}
    fixed, weights = shift.correct(d, goal, by="country")
    for c in "AB":
        alone, own = shift.correct(d.where(F.col("country") == c), {cat: v for (x, cat), v in goal.items() if x == c})
        assert {cat: w for (x, cat), w in weights.items() if x == c} == pytest.approx(own) and own["dbig_true"] == 0
        got = {x.t: x.p for x in fixed.where(F.col("country") == c).collect()}
        assert got == pytest.approx({x.t: x.p for x in alone.collect()})


def test_exclusive_and_decode(spark):
    d = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.9), ("a", "y", 0.8), ("b", "z", 0.05)], "q string, t string, p double")
    assert decode.exclusive(d).where("t = 'x'").count() == 1
    assert decode.exclusive(d, keep_ties=True).where("t = 'x'").count() == 2
    m = {(r.q, r.t) for r in decode.decode(d).collect()}
    assert m == {("a", "x"), ("a", "y")}
    assert decode.decode(d.limit(0)).count() == 0


def test_rules_round_trip(spark):
    maps = {"nm": {"pvt": "private"}, "addr": {}, "translit": {"gret": "great"}, "by_country": {"F": {"nm": {}, "addr": {"r": "rue x"}}}}
    assert rules.as_maps(rules.from_maps(spark, maps)) == maps
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "x a")], "x string, y string")
    assert {r.x for r in rules.without_chains(chain).collect()} == {"d"}


def test_set_rows(spark):
    p = spark.createDataFrame([("1", "b", 0.5), ("1", "a", 0.9), ("1", "a", 0.9)], "q string, t string, p double")
    every = spark.createDataFrame([("1",), ("2",)], "id string")
    assert {r[0]: r[1] for r in tables.set_rows(p, every, "m", "p").collect()} == {"1": "a,b", "2": ""}


def test_hash_folds_are_stable(spark):
    assert spark.range(1).select(sampling.hash100(F.lit("S1-1"))).first()[0] == int(__import__("hashlib").md5(b"S1-1").hexdigest()[:8], 16) % 100


@pytest.mark.slow
def test_whole_run(spark, tmp_path):
    """Files in, files out: recall of the candidates and the final score on a problem with known truth."""
    n, words = 240, "north south lake river stone iron amber cedar maple grove".split()
    def name(k):
        return f"{words[k % 10]} {words[(k // 10) % 10]} works{k}"
    for split in ("train", "test"):
        rows = {s: ["entity_id\tbusiness_name\tbusiness_address\tcountry"] for s in "123"}
        truth = ["source1_entity_id\tmatched_entity_ids"]
        for k in range(n):
            c = "AB"[k % 2]
            rows["1"].append(f"S1-{k}\t{name(k)} Ltd\t{100 + k} Main St\t{c}")
            rows["2"].append(f"S2-{k}\t{name(k).upper()} LIMITED\t{100 + k} Main Street\t{c}")
            rows["3"].append(f"S3-{k}\t{name(k + 1000)}\t{700 + k} Side Rd\t{c}")
            truth.append(f"S1-{k}\tS2-{k}")
        (tmp_path / split).mkdir()
        for s in "123":
            (tmp_path / split / f"{split}_source{s}.tsv").write_text("\n".join(rows[s]) + "\n")
        (tmp_path / split / f"{split}_ground_truth.tsv").write_text("\n".join(truth) + "\n")
    config = LinkConfig(data=str(tmp_path), work=str(tmp_path / "work"), out=str(tmp_path / "out"), k_word=4, k_char=3, stage1_folds=15, stage2_folds=30, stage3_folds=30, valid_folds=10, early_stop_from=40, selftrain_countries="A")
    job = Linkage(spark, config, maxIter=3, maxDepth=3, minInstancesPerNode=5)
    matches = {(r.q, r.t) for r in job.run().collect()}
    true = {(f"S1-{k}", f"S2-{k}") for k in range(n)}
    assert len(matches & true) > 0.9 * n and len(matches - true) < 0.1 * n
    assert spark.read.csv(f"{config.out}/matching_results.tsv", sep="\t", header=True).count() == n
