"""Learned operators: span scorer, null head, risk model with isotonic calibration, and what is made of them.

All are boosted trees over histograms (:mod:`quillspan.operators.boosting`) of 200
rounds at a rate of 0.1, fitted on all rows; every fit takes a seed.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import hash_draw, normalize_answer
from quillspan.operators import boosting
from quillspan.operators import spans as S
from quillspan.operators.boosting import Trees
from quillspan.operators.signals import SIGNALS
from quillspan.session import materialize

ITERATIONS, RATE, SEED = 200, 0.1, 0


def save_models(models: dict[str, tuple[Trees, list[str]]], path: str) -> None:
    """Write models by name, a row each."""
    spark = SparkSession.active()
    rows = [(name, bytearray(trees.packed()), columns) for name, (trees, columns) in models.items()]
    spark.createDataFrame(rows, "name string, body binary, columns array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_models(path: str) -> dict[str, tuple[Trees, list[str]]]:
    """Models that :func:`save_models` wrote."""
    return {r["name"]: (boosting.unpacked(r["body"]), r["columns"]) for r in SparkSession.active().read.parquet(path).collect()}  # a row a model


class RiskModel:
    """The probability of an error: trees on one part, isotonic calibration on another."""

    def __init__(self, columns: list[str] | None = None, iterations: int = ITERATIONS, seed: int = SEED) -> None:
        self.columns, self.iterations, self.seed = columns or SIGNALS, iterations, seed
        self.trees: Trees | None = None

    def fit(self, rows: DataFrame, label: str = "error") -> RiskModel:
        self.trees = boosting.fit_models(rows, {"risk": (self.columns, label)}, rounds=self.iterations, seed=self.seed)["risk"]
        return self

    def calibrate(self, rows: DataFrame, label: str = "error") -> RiskModel:
        """Isotonic calibration on all rows."""
        held = boosting.scored(rows.select(*self.columns, F.col(label).cast("double").alias("_y")), {"_p": (self.trees, self.columns)}, calibrated=False)
        self.trees.xs, self.trees.ys = boosting.isotonic_steps(held, ["_p"], {"_p": "_y"})["_p"]
        return self

    def risk(self, rows: DataFrame, calibrated: bool = True) -> DataFrame:
        """Add ``risk``, between 0 and 1."""
        return boosting.scored(rows, {"risk": (self.trees, self.columns)}, calibrated)

    def save(self, path: str) -> None:
        save_models({"risk": (self.trees, self.columns)}, path)


def load_risk_model(path: str) -> RiskModel:
    """A model that was saved with :meth:`RiskModel.save`."""
    trees, columns = load_models(path)["risk"]
    out = RiskModel(columns)
    out.trees = trees
    return out


def risk_models(rows: DataFrame, specs: dict[str, tuple[list[str], str]], iterations: int = ITERATIONS, seed: int = SEED) -> dict[str, tuple[Trees, list[str]]]:
    """Fit (on rel_train) and calibrate (on rel_calib) a model for each of ``specs``, all in one job; ``rows`` have ``part``."""
    own = rows.where("part IN ('rel_train', 'rel_calib')").withColumn("_late", F.col("part") == "rel_calib")
    made = boosting.fit_models(own, specs, calibrates="_late", rounds=iterations, seed=seed)
    return {name: (made[name], columns) for name, (columns, _) in specs.items()}


def scores_of(rows: DataFrame, models: dict[str, tuple[Trees, list[str]]], *more: str, calibrated: bool = True) -> DataFrame:
    """``method, ord, article, risk, correct`` (and ``more``) of every row by each model."""
    wide = boosting.scored(rows, {f"_m{k}": m for k, m in enumerate(models.values())}, calibrated)
    pairs = F.array(*[F.struct(F.lit(name).alias("method"), F.col(f"_m{k}").alias("risk")) for k, name in enumerate(models)])
    return wide.select("ord", "article", "correct", *more, F.explode(pairs).alias("_z")).select(F.col("_z.method").alias("method"), "ord", "article", F.col("_z.risk").alias("risk"), "correct", *more)


#: What each method is.
METHODS = {
    "B1": "always answer",
    "B2": "span probability alone",
    "B3": "first retrieval score alone",
    "B4": "null score alone",
    "B5": "calibrated risk from the reader's signals",
    "P1": "calibrated risk from all sixteen signals",
}


def described(rows: DataFrame) -> DataFrame:
    """Add ``description`` to rows with a ``method``; unknown methods have none."""
    names = rows.sparkSession.createDataFrame(list(METHODS.items()), "method string, description string")
    return rows.join(F.broadcast(names), "method", "left")  # six rows


def closed_methods(rows: DataFrame, *more: str) -> DataFrame:
    """``method, ord, article, risk, correct`` (and ``more``) of the four methods without a model: always answer, span probability, first score, null score."""
    risks = {"B1": F.lit(0.0), "B2": -F.col("d_span_prob"), "B3": -F.col("r_sim_top1"), "B4": F.col("d_null_score")}
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), r.cast("double").alias("risk")) for m, r in risks.items()])
    return rows.select("ord", "article", "correct", *more, F.explode(pairs).alias("_m")).select(F.col("_m.method").alias("method"), "ord", "article", F.col("_m.risk").alias("risk"), "correct", *more)


def training_spans(featured: DataFrame, golds: DataFrame, per_positive: int = 400, seed: int = SEED, features: list[str] = S.FEATURES) -> DataFrame:
    """The span scorer's rows with ``label``, ``weight`` (both labels weigh the same in all) and their ``features``.

    ``featured`` are candidates with features and their text ``answer``, ``golds`` has ``qid, golds (normalised), is_impossible``. Questions with an answer that no
    candidate equals are left out; negatives are drawn without replacement,
    ``per_positive`` for each positive, or as many for an unanswerable question.
    """
    rows = featured.withColumn("_norm", normalize_answer(F.col("answer"))).join(golds.hint("merge"), "qid")
    rows = rows.withColumn("label", (~F.col("is_impossible") & F.array_contains("golds", F.col("_norm"))).cast("double"))
    w = Window.partitionBy("qid")
    rows = rows.withColumn("_pos", F.sum("label").over(w)).where("is_impossible OR size(golds) = 0 OR _pos > 0")
    order = Window.partitionBy("qid", "label").orderBy(hash_draw(F.lit(str(seed)), F.col("qid"), F.col("start").cast("string"), F.col("len").cast("string")), "start", "len")
    rows = rows.withColumn("_k", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("_k") <= per_positive * F.greatest(F.col("_pos"), F.lit(1.0))))
    rows = materialize(rows.select("qid", "pid", "start", "len", "label", *features), "training-spans")
    totals = rows.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = totals["p"] or 0.0, totals["n"] or 0
    weight = F.when(F.col("label") == 1, n / (2 * p) if p else 1.0).otherwise(n / (2 * (n - p)) if n > p else 1.0)
    return rows.select("qid", "pid", "start", "len", "label", weight.alias("weight"), *features)


def null_features(scored: DataFrame, asked: DataFrame, toks: DataFrame) -> DataFrame:
    """``qid, pid`` and the null head's eight features from the candidates' scores ``raw``."""
    lows = toks.groupBy("pid").agg(F.collect_set("low").alias("_lows"), F.first("n").alias("n_tokens"))
    w = Window.partitionBy("qid", "pid").orderBy(F.desc("raw"))
    ranked = scored.select("qid", "pid", "raw").withColumn("_k", F.row_number().over(w))
    at = lambda k: F.coalesce(F.max(F.when(F.col("_k") == k, F.col("raw"))), F.lit(0.0))
    top = ranked.groupBy("qid", "pid").agg(*[at(k).alias(f"_t{k}") for k in range(1, 6)], F.count(F.lit(1)).alias("_n"), F.stddev_pop("raw").alias("n_std"))
    rows = top.join(asked.select("qid", "pid", "words").hint("merge"), ["qid", "pid"]).join(lows.hint("merge"), "pid")
    t = [F.col(f"_t{k}") for k in range(1, 6)]
    return rows.select(
        "qid", "pid", t[0].alias("n_top1"), ((t[0] + t[1] + t[2]) / 3).alias("n_top3"), ((t[0] + t[1] + t[2] + t[3] + t[4]) / 5).alias("n_top5"),
        F.when(F.col("_n") > 1, t[0] - t[1]).otherwise(0.0).alias("n_gap"), "n_std",
        F.when(F.size("words") > 0, F.size(F.array_intersect("_lows", "words")) / F.greatest(F.size("words"), F.lit(1))).otherwise(0.0).alias("n_overlap"),
        F.size("words").cast("double").alias("n_words"), F.col("n_tokens").cast("double").alias("n_tokens"),
    )


NULL_FEATURES = "n_top1 n_top3 n_top5 n_gap n_std n_overlap n_words n_tokens".split()


class SpanReader(Protocol):
    """What answering needs of a reader: any object with this method can stand in for :class:`Reader`."""

    def read(self, asked: DataFrame, passages: DataFrame) -> DataFrame:
        """``qid, rank, pid, answer, raw, prob, entropy, len, null_score`` for ``asked``: ``qid, rank, pid, score, words, qtype``."""


class Reader:
    """Picks a span in each passage read and the best over the passages; ``null_score`` says how likely there is no answer."""

    def __init__(self, idf: DataFrame, per_positive: int = 400, iterations: int = ITERATIONS, seed: int = SEED) -> None:
        self.idf, self.per_positive, self.iterations, self.seed = idf, per_positive, iterations, seed
        self.scorer: Trees | None = None
        self.null: Trees | None = None

    def fit(self, questions: DataFrame, passages: DataFrame) -> Reader:
        """``questions``: ``qid, gold_pid, question, answers, is_impossible`` of the training part; ``passages``: ``pid, article, text``."""
        asked = S.question_words(questions.where("gold_pid IS NOT NULL"))
        toks = materialize(S.tokens(passages.join(asked.select("pid").distinct().hint("merge"), "pid", "left_semi")), "reader-tokens")
        cands = S.candidates(toks)
        featured = materialize(S.features(asked, toks, self.idf, cands), "reader-features")
        gold = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: normalize_answer(a)), lambda a: a != "")
        golds = questions.select("qid", gold.alias("golds"), F.coalesce("is_impossible", F.lit(False)).alias("is_impossible")).dropDuplicates(["qid"])
        rows = training_spans(S.span_texts(featured, passages), golds, self.per_positive, self.seed)
        self.scorer = boosting.fit_models(materialize(rows, "reader-rows"), {"span": (list(S.FEATURES), "label")}, weight="weight", rounds=self.iterations, seed=self.seed)["span"]
        raw = self._raw(featured)
        heads = null_features(raw, asked, toks).join(golds.select("qid", F.col("is_impossible").cast("double").alias("label")).hint("merge"), "qid")
        self.null = boosting.fit_models(materialize(heads, "reader-heads"), {"null": (NULL_FEATURES, "label")}, rounds=self.iterations, seed=self.seed)["null"]
        return self

    def _raw(self, featured: DataFrame) -> DataFrame:
        return boosting.scored(featured, {"raw": (self.scorer, list(S.FEATURES))}, calibrated=False)

    def save(self, path: str) -> None:
        """Write the term weights and both models."""
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        save_models({"span": (self.scorer, list(S.FEATURES)), "null": (self.null, NULL_FEATURES)}, f"{path}/models")

    def read(self, asked: DataFrame, passages: DataFrame) -> DataFrame:
        """``qid, rank, pid, answer, raw, prob, entropy, len, null_score``: the best span of each passage read.

        ``asked``: ``qid, rank, pid, score, words, qtype``. Passages without
        candidates give no row; equal scores go to the earlier, shorter span.
        """
        from quillspan.operators.signals import softmax

        toks = materialize(S.tokens(passages.join(asked.select("pid").distinct().hint("merge"), "pid", "left_semi")), "reader-tokens")
        cands = S.candidates(toks)
        raw = materialize(self._raw(S.features(asked.drop("rank"), toks, self.idf, cands)).select("qid", "pid", "start", "len", "c0", "c1", "raw"), "spans-scored")
        scored = softmax(raw, ["qid", "pid"], "raw")
        w = Window.partitionBy("qid", "pid").orderBy(F.desc("raw"), "start", "len")
        best = scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("qid", "pid", "start", "len", "c0", "c1", "raw", "prob", "entropy")
        nulls = boosting.scored(null_features(raw, asked, toks), {"null_score": (self.null, NULL_FEATURES)}, calibrated=False).select("qid", "pid", "null_score")
        named = S.span_texts(best, passages).drop("c0", "c1")
        return named.join(nulls.hint("merge"), ["qid", "pid"]).join(asked.select("qid", "pid", "rank").hint("merge"), ["qid", "pid"])


def load_reader(path: str) -> Reader:
    """A reader that was saved with :meth:`Reader.save`."""
    out = Reader(SparkSession.active().read.parquet(f"{path}/idf"))
    models = load_models(f"{path}/models")
    out.scorer, out.null = models["span"][0], models["null"][0]
    return out
