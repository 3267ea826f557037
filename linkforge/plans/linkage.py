"""The linkage run: each step reads tables of the work folder and writes its own.

All countries and sources go through one plan a step, keyed by (country, src); nothing loops over them.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.text import normalise
from ..operators import anchors, pairs, rules, shift, uniqueness
from ..operators.blocking import block
from ..operators.decode import decode, exclusive
from ..operators.sampling import hash100, train_subsample
from ..sources import tables
from . import evaluate, learn

BASE = pairs.PAIR_FEATURES + pairs.LIST_FEATURES
STAGE1 = BASE + uniqueness.FEATURES
STAGE2 = STAGE1 + ["p1"] + pairs.PROB_FEATURES
STAGE3 = STAGE2 + anchors.FEATURES


def narrow(f: DataFrame) -> DataFrame:
    """Features as they are stored: single precision, and counts as 32-bit numbers."""
    kinds = {"double": "float", "bigint": "int"}
    return f.select(*[F.col(c).cast(kinds.get(t, t)).alias(c) for c, t in f.dtypes])


class Linkage:
    def __init__(self, spark: SparkSession, config: LinkConfig | None = None, **model):
        self.spark, self.c, self.model = spark, config or LinkConfig.from_env(), model

    # tables of the work folder
    def path(self, name: str) -> str:
        return f"{self.c.work}/{name}"

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(self.path(name))
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def truth(self) -> DataFrame:
        return tables.read_truth(self.spark, f"{self.c.data}/train/train_ground_truth.tsv")

    # 1. normalisation
    def prep(self, split: str) -> DataFrame:
        every = None
        for src in "123":
            raw = tables.read_records(self.spark, f"{self.c.data}/{split}/{split}_source{src}.tsv")
            raw = normalise(raw).withColumn("src", F.lit(src))
            every = raw if every is None else every.unionByName(raw)
        return self.put(every, f"records_{split}", "src")

    def records(self, split: str, rewritten: bool = True, countries: list[str] | None = None) -> DataFrame:
        """Records of a split; the condition on countries reaches the scan."""
        df = tables.read_columns(self.spark, self.path(f"records_{split}"), where=F.col("country").isin(countries) if countries else None)
        df = df.withColumn("src", F.col("src").cast("string"))
        return rules.rewrite(df, self.maps()) if rewritten else df

    def maps(self) -> dict:
        return rules.as_maps(self.get("rules"))

    # 2. rewrite rules from labelled pairs
    def mine(self) -> DataFrame:
        df, truth = self.records("train", rewritten=False), self.truth()
        s1, sources = df.where("src = '1'"), [df.where(F.col("src") == s) for s in "23"]
        out = None
        for field in ("nm", "addr", "translit"):
            if field == "translit":
                found = rules.merge([rules.mine_positional(truth, s1, t) for t in sources])
            else:
                found = rules.without_chains(rules.merge([rules.mine(truth, s1, t, field) for t in sources]))
            found = found.select(F.lit("all").alias("scope"), F.lit("").alias("country"), F.lit(field).alias("field"), "x", "y")
            out = found if out is None else out.unionByName(found)
        return self.put(out, "rules")

    # 3. candidates with features
    def sides(self, split: str) -> tuple[DataFrame, DataFrame]:
        df = self.records(split)
        s1, targets = df.where("src = '1'"), df.where("src <> '1'")
        if split == "train":
            return train_subsample(s1, targets, self.truth(), self.c.query_pct, self.c.orphan_pct, self.c.never_matched_pct)
        return s1, targets

    def candidates(self, split: str) -> DataFrame:
        c = self.c
        s1, targets = self.sides(split)
        found = block(s1, targets, c.k_word, c.k_char, c.thr_word, c.thr_char, c.max_df, c.min_df_cap)
        f = pairs.list_features(pairs.pair_features(pairs.with_records(found, s1, targets)))
        return self.put(narrow(uniqueness.enrich(f, *uniqueness.uniqueness(s1, targets))), f"candidates_{split}", "country")

    def labelled(self) -> DataFrame:
        return learn.with_labels(self.get("candidates_train"), self.truth()).withColumn("fold", hash100(F.col("q")))

    @property
    def valid_from(self) -> int:
        return 50 - self.c.valid_folds

    # 4. stages of models
    def _save(self, model: PipelineModel, name: str) -> PipelineModel:
        model.write().overwrite().save(self.path(name))
        return model

    def _report(self, model: PipelineModel, train: DataFrame, valid: DataFrame, name: str) -> None:
        """Rows and matches that a model saw, and what its features are worth: ``report_<name>``, ``gain_<name>``."""
        count = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("matches")]
        rows = {k: df.agg(*count).first() for k, df in (("train", train), ("valid", valid))}
        tables.write_json(self.spark, {k: {"rows": r.n, "matches": r.matches or 0} for k, r in rows.items()}, self.path(f"report_{name}"))
        self.put(learn.importances(model), f"gain_{name}")

    def load(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.path(name))

    def train(self, train_folds: int = 12, valid_folds: int = 6) -> dict:
        f = self.labelled()
        train, valid = f.where(F.col("fold") < train_folds), f.where(F.col("fold") >= 50 - valid_folds)
        m = self._save(learn.fit(train, valid, BASE, **self.model), "model_base")
        self._report(m, train, valid, "base")
        self._predict_valid(m, valid)
        return self.evaluate(valid_folds)

    def train2(self) -> dict:
        c, f = self.c, self.labelled()
        a, b, scored = learn.cross_fit(f, f.where(F.col("fold") >= c.early_stop_from), STAGE1, c.stage1_folds, **self.model)
        self._save(a, "model_1a"), self._save(b, "model_1b")
        self.put(pairs.prob_context(scored.select("q", "t", "src", "p1")), "context_train")
        f = f.join(self.get("context_train"), ["q", "t", "src"], "left")
        valid = f.where(F.col("fold") >= self.valid_from)
        train = f.where(F.col("fold") < c.stage2_folds)
        m = self._save(learn.fit(train, valid, STAGE2, **self.model), "model_2")
        self._report(m, train, valid, "2")
        self._predict_valid(m, valid)
        return self.evaluate()

    def train3(self, extra: DataFrame | None = None) -> dict:
        """``extra``: pseudo-labelled rows with all features and y."""
        c = self.c
        f = self.labelled().join(self.get("context_train"), ["q", "t", "src"], "left")
        f = f.where((F.col("fold") < c.stage3_folds) | (F.col("fold") >= self.valid_from))
        recs = tables.target_records(self.records("train"), f.select(F.col("t").alias("id")).distinct())
        self.put(anchors.anchor_features(f.select("q", "t", "src", "p1"), recs), "anchors_train")
        f = f.join(self.get("anchors_train"), ["q", "t"], "left")
        train, valid = f.where(F.col("fold") < c.stage3_folds), f.where(F.col("fold") >= self.valid_from)
        if extra is not None:
            train = train.select("y", *STAGE3).unionByName(extra.select("y", *STAGE3))
        m = self._save(learn.fit(train, valid, STAGE3, **self.model), "model_3")
        self._report(m, train, valid, "3")
        self._predict_valid(m, valid)
        return self.evaluate()

    def _predict_valid(self, model: PipelineModel, valid: DataFrame) -> None:
        keep = [c for c in ("q", "t", "p", "p1", "y", "src", "country") if c in {*valid.columns, "p"}]
        self.put(learn.score(model, valid).select(*keep), "valid_scores")

    def evaluate(self, valid_folds: int | None = None) -> dict:
        scored = self.get("valid_scores")
        s1 = self.records("train", rewritten=False).where("src = '1'").select(F.col("id").alias("q"), "country")
        fold = hash100(F.col("q"))
        every = s1.where((fold >= 50 - (valid_folds or self.c.valid_folds)) & (fold < 50))
        truth = self.truth().join(every, "q", "left_semi")
        table = self.put(evaluate.ablation(scored, truth, every), "ablation")
        best = evaluate.best_config(table)
        tables.write_json(self.spark, best, self.path("decode.json"))
        self.put(evaluate.by_country(decode(scored), truth, every), "valid_by_country")
        return {**best, "ceiling": evaluate.recall_ceiling(scored, truth).first().ceiling}

    # 5. scoring
    def predict(self) -> DataFrame:
        """First stage only."""
        scored = self.put(learn.score(self.load("model_base"), self.get("candidates_test")).select("q", "t", "p"), "scores")
        return self._write(scored, decode(scored))

    def predict2(self, stage: str = "2", threshold: float = 0.7) -> DataFrame:
        f = self.get("candidates_test")
        first = self.put(learn.score(self.load("model_1a"), f, "p1").select("q", "t", "src", "p1"), "first_test")
        f = f.join(self.put(pairs.prob_context(first), "context_test"), ["q", "t", "src"], "left")
        model = self.load(f"model_{stage}")
        if anchors.FEATURES[0] in learn.features_of(model):
            recs = tables.target_records(self.records("test"), first.select(F.col("t").alias("id")).distinct())
            f = f.join(self.put(anchors.anchor_features(first, recs), "anchors_test"), ["q", "t"], "left")
        scored = self.put(learn.score(model, f).select("country", "q", "t", "p1", "p"), f"scores_{stage}")
        try:
            best = tables.read_json(self.spark, self.path("decode.json"))
        except Exception as e:  # no evaluation ran before
            if "PATH_NOT_FOUND" not in str(e):
                raise
            best = {"mode": "exclusive", "value": threshold}
        return self._write(scored, evaluate.apply_config(scored, best))

    def predict3(self) -> DataFrame:
        return self.predict2("3")

    def _write(self, scored: DataFrame, matches: DataFrame) -> DataFrame:
        matches = self.put(matches.select("q", "t"), "matches")
        every = self.records("test", rewritten=False).where("src = '1'").select("id")
        tables.write_outputs(scored, matches, every, self.c.out)
        return matches

    # 6. rules for countries without labels
    def selftrain(self) -> DataFrame:
        wanted = [x for x in self.c.selftrain_countries.split(",") if x]
        df = self.records("test", countries=wanted)
        sure = exclusive(self.get("scores_2"), keep_ties=True).where(F.col("p") >= self.c.pseudo_p).select("country", "q", "t")
        out = self.get("rules").where("scope = 'all'")
        for country in wanted:
            here = df.where(F.col("country") == country)
            found = sure.where(F.col("country") == country).select("q", "t")
            for field in ("nm", "addr"):
                mined = [rules.mine_multi(found, here.where("src = '1'"), here.where(F.col("src") == s), field) for s in "23"]
                r = rules.without_chains(rules.merge(mined))
                out = out.unionByName(r.select(F.lit("country").alias("scope"), F.lit(country).alias("country"), F.lit(field).alias("field"), "x", "y"))
        return self.put(self.put(out, "rules_next"), "rules")  # the plan of rules_next reads rules

    # 7. label shift
    def shift(self) -> DataFrame:
        """Corrects each country by the validation rates of its own labels, or of the reference country."""
        va = self.get("valid_scores").select("q", "t", "p")
        train = self.records("train")
        home = train.where("src = '1'").select(F.col("id").alias("q"), "country")
        known = shift.categories(va, shift.first_number(train)).join(home, "q")
        rates = shift.rate_map(known, "country")
        names = sorted({c for c, _ in rates})
        stand_in = self.c.shift_reference or (names[0] if names else "")
        d = self.put(shift.categories(self.get("scores_3"), shift.first_number(self.records("test"))), "shift_input")
        reference: dict = {}
        for r in d.select("country").distinct().collect():
            model = r.country if r.country in names else stand_in
            reference |= {(r.country, cat): rate for (c, cat), rate in rates.items() if c == model}
        fixed, found = shift.correct(d, reference, by="country")
        weights: dict = {}
        for (c, cat), w in found.items():
            weights.setdefault(c, {})[cat] = w
        out = decode(fixed).select("q", "t")
        tables.write_json(self.spark, weights, self.path("shift.json"))
        out = self.put(out, "matches")
        every = self.records("test", rewritten=False).where("src = '1'").select("id")
        tables.write_tsv(tables.set_rows(out, every, "matched_entity_ids"), f"{self.c.out}/matching_results.tsv")
        return out

    def run(self) -> DataFrame:
        """All steps in order; countries without labels are blocked twice."""
        self.prep("train"), self.prep("test"), self.mine()
        self.candidates("train"), self.candidates("test")
        self.train(), self.train2(), self.predict2()
        if self.c.selftrain_countries:
            self.selftrain()
            self.candidates("test")
        self.train3(), self.predict3()
        return self.shift()
