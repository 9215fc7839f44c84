"""Queries over predictions, splits, draws and the query log, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import ask, learned, metrics, resample, signals
from quillspan.plans.corpus_queries import QTYPE
from quillspan.session import materialize
from quillspan.sources.tables import table

REPS, SEED = 1000, 7
#: Times that each signal is shuffled for its importance.
SHUFFLES = 10
FRACTIONS = {"reader_train": 0.4, "rel_train": 0.2, "rel_calib": 0.1, "test": 0.3}
_PUNCT = T.PUNCTUATION.replace("'", "''")
NORM = lambda c: (
    f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(translate(lower(coalesce({c}, '')), '{_PUNCT}', ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda t: CASE WHEN t IN ('a', 'an', 'the') THEN ' ' ELSE t END), ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
)
BLANK = lambda c: f"({c} IS NULL OR regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g') = '')"
ORD = "struct_pack(a := coalesce(article, ''), b := coalesce(qid, ''), c := coalesce(run_id, ''), d := coalesce(epoch_us(written_at), 0), e := coalesce(pred, ''))"
FIN = lambda c: f"CASE WHEN isfinite(features.{c}) THEN features.{c} ELSE 0 END"
PREDS = f"""pr AS (SELECT DISTINCT * FROM predictions_a),
pa AS (SELECT *, list_filter(string_split({NORM('pred')}, ' '), lambda x: x <> '') AS pt FROM pr),
f1s AS (SELECT *, coalesce(list_max(list_transform(list_transform(coalesce(answers, []), lambda g: list_filter(string_split({NORM('g')}, ' '), lambda x: x <> '')), lambda g:
  CASE WHEN len(pt) = 0 OR len(g) = 0 THEN CASE WHEN len(pt) = 0 AND len(g) = 0 THEN 1.0 ELSE 0.0 END
  ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) / (len(pt) + len(g)) END)), 0) AS f1,
  CASE WHEN len(list_filter(coalesce(answers, []), lambda g: {NORM('g')} = {NORM('pred')})) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em FROM pa),
lab AS (SELECT *, CAST(CASE WHEN coalesce(is_impossible, false) THEN {BLANK('pred')} ELSE NOT {BLANK('pred')} AND f1 >= 0.5 END AS DOUBLE) AS correct, {ORD} AS ord FROM f1s)"""
SCORED = f"""{PREDS}, sc AS (SELECT 'B1' AS method, ord, article, 0.0 AS risk, correct FROM lab UNION ALL SELECT 'B2', ord, article, -({FIN('d_span_prob')}), correct FROM lab
UNION ALL SELECT 'B3', ord, article, -({FIN('r_sim_top1')}), correct FROM lab UNION ALL SELECT 'B4', ord, article, {FIN('d_null_score')}, correct FROM lab)"""
CURVE = f"""{SCORED}, cv AS (SELECT *, rn / n AS coverage, errs / rn AS selective_risk FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY method) AS n, sum(1 - correct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errs FROM sc WINDOW w AS (PARTITION BY method ORDER BY risk, ord)))"""
AUC = """auc AS (SELECT method, CASE WHEN sum(1 - correct) = 0 OR sum(correct) = 0 THEN 'NaN'::DOUBLE ELSE (sum(CASE WHEN correct = 0 THEN mid END) - sum(1 - correct) * (sum(1 - correct) + 1) / 2) / (sum(1 - correct) * sum(correct)) END AS error_auc
  FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY risk) + (count(*) OVER (PARTITION BY method, risk) - 1) / 2 AS mid FROM sc) GROUP BY 1)"""
DRAW = lambda *p: f"('0x' || substr(md5({' || $$|$$ || '.join(p)}), 1, 8))::BIGINT"
BOOT = f"""arts AS (SELECT article, row_number() OVER (ORDER BY article) - 1 AS k FROM (SELECT DISTINCT article FROM sc WHERE article IS NOT NULL)), na AS (SELECT count(*) AS n FROM arts),
dr AS (SELECT rep, slot, article FROM (SELECT r.rep, s.slot, {DRAW(f"'{SEED}'", 'CAST(r.rep AS VARCHAR)', 'CAST(s.slot AS VARCHAR)')} % (SELECT n FROM na) AS k FROM (SELECT unnest(range({REPS})) AS rep) r, (SELECT unnest(range((SELECT n FROM na))) AS slot) s) JOIN arts USING (k)),
rs AS (SELECT rep, slot, method, sc.article, risk, correct, ord FROM dr JOIN sc USING (article)),
rv AS (SELECT rep, method, avg(errs / rn) AS value FROM (SELECT rep, method, row_number() OVER w AS rn, sum(1 - correct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errs FROM rs WINDOW w AS (PARTITION BY rep, method ORDER BY risk, slot, ord)) GROUP BY 1, 2)"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Different predictions with scores, label, order and the sixteen signals."""
    p = table(spark, folder, "predictions_a").distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = F.struct(text("article").alias("a"), text("qid").alias("b"), text("run_id").alias("c"), F.coalesce(F.unix_micros("written_at"), F.lit(0)).alias("d"), text("pred").alias("e"))
    rows = p.select(
        "*", order.alias("ord"), T.best_f1(F.col("pred"), F.col("answers")).alias("f1"), T.exact_match(F.col("pred"), F.col("answers")).alias("em"),
        T.is_correct(F.col("pred"), F.col("answers"), F.col("is_impossible")).cast("double").alias("correct"),
    )
    return rows.select("*", *[T.finite_or_zero(F.col(f"features.{c}")).alias(c) for c in signals.SIGNALS])


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return learned.closed_methods(_labelled(spark, folder))


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.risk_coverage(_scored(spark, folder))


def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Exact match, F1 and label of every prediction."""
    return _labelled(spark, folder).select("run_id", "qid", "pred", "em", F.round("f1", 6).alias("f1"), "correct")


def part_report(spark: SparkSession, folder: str) -> DataFrame:
    """By part: questions, articles, unanswerable share, gold retrieved, EM and F1 of answerable questions, error rate."""
    rows = _labelled(spark, folder).join(table(spark, folder, "article_split"), "article")
    imp = F.coalesce("is_impossible", F.lit(False))
    r = lambda c: F.round(c, 6)
    return rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("article").alias("articles"), r(F.avg(imp.cast("int"))).alias("unanswerable"), r(F.avg(F.col("gold_retrieved").cast("int"))).alias("gold_in_k"),
        r(F.avg(F.when(~imp, F.col("em")))).alias("em"), r(F.avg(F.when(~imp, F.col("f1")))).alias("f1"), r(F.avg(1 - F.col("correct"))).alias("error_rate"),
    )


def by_question_type(spark: SparkSession, folder: str) -> DataFrame:
    """By type of question: predictions, accuracy and mean risk (the null score). Questions that aren't known are 'other'."""
    q = table(spark, folder, "questions").where("qid IS NOT NULL").groupBy("qid").agg(F.min("question").alias("question"))
    rows = _labelled(spark, folder).join(q, "qid", "left").withColumn("qtype", T.question_type(F.col("question")))
    return rows.groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("d_null_score"), 6).alias("mean_risk"))


def error_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """What went wrong, with counts and shares: unanswerable, gold passage not retrieved, no overlap, too little of it, in this order; what is left is right."""
    kind = (
        F.when(F.coalesce("is_impossible", F.lit(False)), "unanswerable_answered").when(~F.coalesce("gold_retrieved", F.lit(False)), "retrieval_miss")
        .when(F.col("f1") == 0, "wrong_span").when(F.col("f1") < 0.5, "partial").otherwise("correct")
    )
    rows = _labelled(spark, folder).withColumn("kind", kind)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def latency(spark: SparkSession, folder: str) -> DataFrame:
    """Median, mean and 95th percentile in milliseconds of the stages, of the whole way (rows with all three times) and of the reliability layer, over finite times of 0 or more.

    The layer is the features' stage and the gate; the gate's time is not in the
    table, so the layer's row holds the features alone and has no mean.
    """
    p = table(spark, folder, "predictions_a").distinct()
    ok = lambda c: F.when(T.finite(F.col(c)) & (F.col(c) >= 0), F.col(c) * 1000)
    stages = [F.struct(F.lit(s).alias("stage"), ok(c).alias("ms")) for s, c in (("t_retrieval",) * 2, ("t_reader",) * 2, ("t_features",) * 2, ("reliability_layer", "t_features"))]
    whole = F.struct(F.lit("end_to_end").alias("stage"), (ok("t_retrieval") + ok("t_reader") + ok("t_features")).alias("ms"))
    long = p.select(F.explode(F.array(*stages, whole)).alias("z")).select("z.*").where("ms IS NOT NULL")
    return long.groupBy("stage").agg(F.round(F.percentile("ms", 0.5), 4).alias("median_ms"), F.round(F.avg("ms"), 4).alias("_mean"), F.round(F.percentile("ms", 0.95), 4).alias("p95_ms"), F.count(F.lit(1)).alias("n")).select(
        "stage", "median_ms", F.when(F.col("stage") != "reliability_layer", F.col("_mean")).alias("mean_ms"), "p95_ms", "n"
    )


def signal_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The sixteen signals of every prediction, what isn't finite as 0."""
    return signals.matrix(table(spark, folder, "predictions_a").distinct(), keep=["run_id", "qid"])


def risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = _curve(spark, folder)
    return c.select("method", F.col("ord.b").alias("qid"), F.col("ord.c").alias("run_id"), "rn", F.round("coverage", 6).alias("coverage"), F.round("selective_risk", 6).alias("selective_risk"))


def aurc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.aurc(_curve(spark, folder)).select("method", F.round("aurc", 6).alias("aurc"))


def error_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.error_auc(_scored(spark, folder)).select("method", F.round("error_auc", 6).alias("error_auc"))


def selective_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.selective_accuracy(_curve(spark, folder), [0.5, 0.7, 0.9]).select("method", "coverage", F.round("accuracy", 6).alias("accuracy"))


def coverage_at_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.coverage_at_accuracy(_curve(spark, folder), [0.4, 0.8, 0.9]).select("method", "target", F.round("coverage", 6).alias("coverage"))


def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ece(_scored(spark, folder).where("method = 'B4'")).select("method", F.round("ece", 6).alias("ece"))


def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.reliability_bins(_scored(spark, folder).where("method = 'B4'"), more_than=20)
    return out.select("method", "bin", "n", F.round("mean_risk", 6).alias("mean_risk"), F.round("error_rate", 6).alias("error_rate"))


def signal_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Densities of the top retrieval score by label, twenty bins."""
    return metrics.histogram(_labelled(spark, folder).select("correct", "r_sim_top1"), ["correct"], "r_sim_top1").select("correct", "bin", "n", F.round("density", 6).alias("density"))


def operating_point(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold that reaches an accuracy of 0.8 on rel_calib, or comes closest, and what it comes to on test."""
    rows = learned.closed_methods(_labelled(spark, folder).join(table(spark, folder, "article_split"), "article"), "part")
    chosen = metrics.choose_threshold(metrics.risk_coverage(rows.where("part = 'rel_calib'").drop("part")), 0.8)
    out = metrics.at_threshold(rows.where("part = 'test'"), chosen, 0.8)
    return out.select("method", *[F.round(c, 6).alias(c) for c in out.columns if c != "method"])


def method_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The methods without a model in one table."""
    out = metrics.comparison(_scored(spark, folder), [0.5, 0.7, 0.9], [0.8, 0.9])
    return out.select("method", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("method", "n")])


def evaluation_gates(spark: SparkSession, folder: str) -> DataFrame:
    """One row of checks over the comparison: the best AUC, and whether null score beats chance, whether each method beats always answering."""
    c = metrics.comparison(_scored(spark, folder), [0.5], [0.8])
    pick = lambda m, v: F.max(F.when(F.col("method") == m, F.col(v)))
    out = c.agg(F.max("error_auc").alias("best"), pick("B4", "error_auc").alias("b4"), pick("B4", "aurc").alias("r4"), pick("B1", "aurc").alias("r1"))
    return out.select(F.round("best", 6).alias("best_auc"), (F.col("b4") > 0.5).alias("null_score_informs"), (F.col("r4") < F.col("r1")).alias("null_score_helps"), F.col("b4").between(0.45, 0.55).alias("near_chance"))


def gated_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction through the gate at 0.5 on its null score, with the reasons for abstaining."""
    rows = _labelled(spark, folder).withColumn("risk", F.col("d_null_score")).withColumn("candidate", F.col("pred"))
    return ask.gate(rows, 0.5).select("run_id", "qid", "answer", F.round("risk", 6).alias("risk"), "abstained", "reason")


def bootstrap_aurc(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the AURC over resampled articles, 1,000 replicates."""
    out = resample.bootstrap_interval(_scored(spark, folder).where("article IS NOT NULL"), "aurc", REPS, SEED)
    return out.select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "reps")


def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The difference in AURC of null score and span probability on the same 1,000 draws."""
    out = resample.paired_difference(_scored(spark, folder).where("article IS NOT NULL"), "B4", "B2", "aurc", REPS, SEED)
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "excludes_zero")


def bootstrap_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the error AUC over resampled articles, 1,000 replicates."""
    out = resample.bootstrap_interval(_scored(spark, folder).where("article IS NOT NULL"), "auc", REPS, SEED)
    return out.select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "reps")


def sampled_articles(spark: SparkSession, folder: str) -> DataFrame:
    return resample.sample_articles(table(spark, folder, "article_split"), 20, SEED)


def capped_questions(spark: SparkSession, folder: str) -> DataFrame:
    """At most eight questions an article, with its share of unanswerable ones."""
    q = table(spark, folder, "questions").select("article", "qid", "is_impossible").distinct()
    return resample.cap_questions(q, 8, SEED)


def article_parts(spark: SparkSession, folder: str) -> DataFrame:
    return resample.split_articles(table(spark, folder, "article_split"), FRACTIONS, SEED)


def split_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Article strings of questions that the split in force gives no part, or several."""
    return resample.split_faults(table(spark, folder, "article_split"), table(spark, folder, "questions"))


def shuffled_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels dealt anew, for the negative control."""
    rows = _labelled(spark, folder).select(F.concat_ws("/", "ord.a", "ord.b", "ord.c", "ord.d", "ord.e").alias("key"), "correct")
    return resample.shuffled(rows, "correct", ["key"], SEED).select("key", "correct")


def extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The least and the most risky prediction and the least risky right one, by null score."""
    rows = _labelled(spark, folder).select("ord", "qid", "run_id", F.col("d_null_score").alias("risk"), "correct")
    low = rows.agg(F.min(F.struct("risk", "ord", "qid", "run_id", "correct")).alias("x")).select(F.lit("lowest").alias("kind"), "x.*")
    high = rows.agg(F.min(F.struct((-F.col("risk")).alias("k"), "ord", "risk", "qid", "run_id", "correct")).alias("x")).select(F.lit("highest").alias("kind"), "x.*")
    right = rows.where("correct = 1").agg(F.min(F.struct("risk", "ord", "qid", "run_id", "correct")).alias("x")).select(F.lit("lowest_correct").alias("kind"), "x.*")
    columns = ["kind", "qid", "run_id", "risk", "correct"]
    return low.select(columns).unionByName(high.select(columns)).unionByName(right.select(columns)).where("risk IS NOT NULL")


def pending_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions outside reader_train without a prediction: what a resumed run has left."""
    q = table(spark, folder, "questions").select("qid", "article").where("qid IS NOT NULL").distinct()
    todo = q.join(table(spark, folder, "article_split").where("part <> 'reader_train'"), "article").select("qid").distinct()
    return ask.unfinished(todo, table(spark, folder, "predictions_a"))


def log_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Different log rows by hour of the event: queries, abstentions and mean finite risk; times in milliseconds are brought to seconds."""
    log = table(spark, folder, "query_log").distinct()
    seconds = F.when(F.col("ts") > 1e11, F.col("ts") / 1000).otherwise(F.col("ts"))
    rows = log.withColumn("hour", F.floor(seconds / 3600).cast("bigint"))
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("queries"), F.sum("abstained").alias("abstained"), F.round(F.avg(F.when(T.finite(F.col("risk")), F.col("risk"))), 6).alias("mean_risk"))


def log_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How often each reason was given."""
    log = table(spark, folder, "query_log").distinct()
    return log.select(F.explode(F.split("reason", "; ")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _by_part(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled predictions with ``error`` and ``part``, written once: every fit of a query reads them."""
    rows = _labelled(spark, folder).withColumn("error", 1 - F.col("correct")).join(table(spark, folder, "article_split"), "article")
    return materialize(rows, "labelled")


_COMPARED = {"B5": (signals.READER, "error"), "P1": (signals.SIGNALS, "error")}


def _compared(rows: DataFrame) -> tuple[DataFrame, dict]:
    """The six methods on the test part, written once, and the two models among them."""
    models = learned.risk_models(rows, _COMPARED)
    test = rows.where("part = 'test'")
    return materialize(learned.closed_methods(test).unionByName(learned.scores_of(test, models)), "compared"), models


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The reader-only and the full risk model beside the methods without one, on the test part, with intervals over 1,000 resamples of articles."""
    scored, _ = _compared(_by_part(spark, folder))
    out = metrics.comparison(scored, [0.5, 0.7, 0.9], [0.8, 0.9]).join(metrics.with_intervals(scored, REPS, SEED), "method")
    return learned.described(out).orderBy("method")


def _paired(scored: DataFrame, pairs: list[tuple[str, str]], reps: int = REPS) -> DataFrame:
    """``pair, mean, low, high, excludes_zero`` of the difference in AURC, all pairs on the same draws."""
    out = None
    values = materialize(resample.replicate_metric(scored, "aurc", reps, SEED), "replicates")
    for a, b in pairs:
        one = resample.difference(values, a, b).select(F.lit(f"{a}-{b}").alias("pair"), "mean", "low", "high", "excludes_zero")
        out = one if out is None else out.unionByName(one)
    return out


def paired_models(spark: SparkSession, folder: str) -> DataFrame:
    """The difference in AURC of the full model with the reader-only one and with the null score, 1,000 replicates."""
    scored, _ = _compared(_by_part(spark, folder))
    return _paired(scored, [("P1", "B5"), ("P1", "B4")])


def _calibration(rows: DataFrame, models: dict, target: float = 0.8) -> DataFrame:
    full = {"P1": models["P1"]}
    calib, test = (rows.where(F.col("part") == p) for p in ("rel_calib", "test"))
    before = metrics.ece(learned.scores_of(test, full, calibrated=False)).withColumnRenamed("ece", "ece_before")
    scored = learned.scores_of(test, full)
    after = metrics.ece(scored).withColumnRenamed("ece", "ece_after")
    chosen = metrics.choose_threshold(metrics.risk_coverage(learned.scores_of(calib, full)), target)
    return before.join(after, "method").join(metrics.at_threshold(scored, chosen, target), "method").withColumn("target", F.lit(target))


def calibration_report(spark: SparkSession, folder: str) -> DataFrame:
    """The full model: calibration error before and after isotonic, the threshold chosen on rel_calib, and what it comes to on test."""
    rows = _by_part(spark, folder)
    return _calibration(rows, learned.risk_models(rows, {"P1": _COMPARED["P1"]}))


def _shuffled_model(rows: DataFrame) -> DataFrame:
    keyed = rows.where("part = 'rel_train'").withColumn("key", F.concat_ws("/", "ord.a", "ord.b", "ord.c", "ord.d", "ord.e"))
    mixed = resample.shuffled(keyed.select("key", "error"), "error", ["key"], SEED)
    model = learned.RiskModel().fit(keyed.drop("error").join(mixed.hint("merge"), "key"))
    scored = model.risk(rows.where("part = 'test'"), calibrated=False).select(F.lit("E0").alias("method"), "ord", "article", "risk", "correct")
    return metrics.error_auc(scored).withColumn("passed", F.col("error_auc").between(0.45, 0.55))


def negative_control(spark: SparkSession, folder: str) -> DataFrame:
    """The error AUC of a model fitted on shuffled labels; it should be near one half."""
    return _shuffled_model(_by_part(spark, folder))


def controlled_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`model_comparison` behind the negative control: raises if a model of shuffled labels tells errors."""
    metrics.require_control(negative_control(spark, folder))
    return model_comparison(spark, folder)


def model_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The seven checks G0 to G6 of the evaluation, from its six tables."""
    rows = _by_part(spark, folder)
    scored, models = _compared(rows)
    return metrics.gates(_shuffled_model(rows), part_report(spark, folder), metrics.error_auc(scored), _paired(scored, [("P1", "B5"), ("P1", "B4")]), _calibration(rows, models), latency(spark, folder))


_FAMILY_SETS = {"full": signals.SIGNALS} | {f"without_{n}": [s for s in signals.SIGNALS if s not in f] for n, f in signals.FAMILIES.items()} | {f"only_{n}": f for n, f in signals.FAMILIES.items()}


def family_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """The model with all signals, without each family and with each alone: error AUC, AURC with interval, and the AURC's difference to the full one's."""
    rows = _by_part(spark, folder)
    models = learned.risk_models(rows, {name: (columns, "error") for name, columns in _FAMILY_SETS.items()})
    scored = materialize(learned.scores_of(rows.where("part = 'test'"), models), "ablation")
    paired = _paired(scored, [(name, "full") for name in _FAMILY_SETS if name != "full"]).select(F.split("pair", "-")[0].alias("method"), F.col("mean").alias("delta"), F.col("low").alias("delta_lo"), F.col("high").alias("delta_hi"), "excludes_zero")
    sizes = spark.createDataFrame([(n, len(c)) for n, c in _FAMILY_SETS.items()], "method string, n_signals int")
    out = metrics.aurc(metrics.risk_coverage(scored)).join(metrics.error_auc(scored), "method").join(metrics.with_intervals(scored, REPS, SEED), "method").join(sizes, "method")
    return out.join(paired, "method", "left").fillna({"delta": 0.0, "delta_lo": 0.0, "delta_hi": 0.0, "excludes_zero": False}).orderBy("method")


def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The rise of the AURC when one signal is shuffled, mean and deviation over ten shuffles, for each signal and its family, the greatest first.

    Each shuffle gives the signal's values new places by draws; the rows of all
    shuffles are scored in one pass and ranked in one plan.
    """
    rows = _by_part(spark, folder)
    models = learned.risk_models(rows, {"P1": _COMPARED["P1"]})
    test = rows.where("part = 'test'").withColumn("key", F.concat_ws("/", "ord.a", "ord.b", "ord.c", "ord.d", "ord.e")).select("key", "ord", "article", "correct", *signals.SIGNALS)
    test = materialize(test, "test-part")
    dealt = resample.shuffled_columns(test, signals.SIGNALS, "key", SHUFFLES, SEED)
    base = test.withColumns({"signal": F.lit("none"), "k": F.lit(0)})
    out = learned.scores_of(base.unionByName(dealt.select(*base.columns)), models, "signal", "k").withColumn("method", F.concat_ws("/", "signal", "k"))
    values = metrics.aurc(metrics.risk_coverage(materialize(out.select("method", "ord", "article", "risk", "correct"), "shuffled-scores")))
    split = values.select(F.split("method", "/")[0].alias("signal"), "aurc")
    base = split.where("signal = 'none'").select(F.col("aurc").alias("base"))
    families = spark.createDataFrame([(s, n) for n, f in signals.FAMILIES.items() for s in f], "signal string, family string")
    rise = split.where("signal <> 'none'").crossJoin(F.broadcast(base)).groupBy("signal").agg(F.avg(F.col("aurc") - F.col("base")).alias("importance"), F.stddev_pop(F.col("aurc") - F.col("base")).alias("deviation"))  # one row
    return rise.join(F.broadcast(families), "signal").orderBy(F.desc("importance"), "signal")  # sixteen rows


def domain_shift(spark: SparkSession, folder: str) -> DataFrame:
    """The full and the reader-only model of one half of the runs applied to the same half and to the other, and those of the other half to itself."""
    rows = _by_part(spark, folder).withColumn("half", T.hash_draw(F.lit("half"), F.col("run_id")) % 2)
    a, b = (rows.where(F.col("half") == h) for h in (0, 1))
    of_a, of_b = learned.risk_models(a, _COMPARED), learned.risk_models(b, _COMPARED)
    out = None
    for name, models, held in (("A->A", of_a, a), ("A->B", of_a, b), ("B->B", of_b, b)):
        one = learned.scores_of(held.where("part = 'test'"), models).withColumn("method", F.concat("method", F.lit(f" {name}")))
        out = one if out is None else out.unionByName(one)
    scored = materialize(out, "shift")
    rates = scored.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("correct")).alias("base_error_rate"))
    all_ = rates.join(metrics.error_auc(scored), "method").join(metrics.aurc(metrics.risk_coverage(scored)), "method").join(metrics.ece(scored), "method").join(metrics.with_intervals(scored, REPS, SEED), "method")
    return all_.select(F.split("method", " ")[0].alias("model"), F.split("method", " ")[1].alias("setting"), *[c for c in all_.columns if c != "method"]).orderBy("model", "setting")


def threshold_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """The full against the reader-only model when an answer counts as right from an F1 of 0.4, 0.5 or 0.6, with 500 replicates of their difference in AURC."""
    base = _by_part(spark, folder)
    limits = (0.4, 0.5, 0.6)
    right = lambda f: T.is_correct(F.col("pred"), F.col("answers"), F.col("is_impossible"), f).cast("double")
    rows = base.withColumns({f"error_{int(f * 10)}": 1 - right(f) for f in limits})
    models = learned.risk_models(rows, {f"{m}@{f}": (c, f"error_{int(f * 10)}") for f in limits for m, (c, _) in _COMPARED.items()})
    out = None
    for f in limits:
        own = {n: m for n, m in models.items() if n.endswith(f"@{f}")}
        one = learned.scores_of(rows.where("part = 'test'").withColumn("correct", 1 - F.col(f"error_{int(f * 10)}")), own)
        out = one if out is None else out.unionByName(one)
    scored = materialize(out, "sensitivity")
    each = metrics.aurc(metrics.risk_coverage(scored)).join(metrics.error_auc(scored), "method").join(scored.groupBy("method").agg(F.avg(1 - F.col("correct")).alias("base_error_rate")), "method")
    at = F.split("method", "@")
    pick = lambda m, c: F.max(F.when(at[0] == m, F.col(c))).alias(f"{m.lower()}_{c}")
    wide = each.groupBy(at[1].cast("double").alias("f1_threshold")).agg(F.max("base_error_rate").alias("base_error_rate"), *[pick(m, c) for m in _COMPARED for c in ("error_auc", "aurc")])
    paired = _paired(scored, [(f"P1@{f}", f"B5@{f}") for f in limits], 500).select(F.regexp_extract("pair", "@([0-9.]+)-", 1).cast("double").alias("f1_threshold"), F.col("mean").alias("delta"), F.col("low").alias("delta_lo"), F.col("high").alias("delta_hi"), (F.col("high") < 0).alias("full_beats_reader"))
    return wide.join(paired, "f1_threshold").orderBy("f1_threshold")


def risk_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Structure of the full model's predictions on each part: rows, all risks between 0 and 1, and calibrated risks that rise with the raw ones."""
    rows = _by_part(spark, folder)
    models = learned.risk_models(rows, {"P1": _COMPARED["P1"]})
    raw = learned.boosting.scored(learned.boosting.scored(rows, {"p": models["P1"]}), {"raw": models["P1"]}, calibrated=False)
    by_raw = raw.groupBy("part", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    falls = F.coalesce(F.col("lo") < F.lag("hi").over(Window.partitionBy("part").orderBy("raw")) - 1e-12, F.lit(False))  # over different raw risks: steps of a few hundred leaves
    return by_raw.withColumn("_f", falls).groupBy("part").agg(F.sum("n").alias("n"), ((F.min("lo") >= 0) & (F.max("hi") <= 1)).alias("in_range"), (F.max(F.col("_f").cast("int")) == 0).alias("rises"))


def answered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: fit a reader on its part, answer every question of the other parts, with signals and evidence."""
    from quillspan.operators import retrieval

    c = retrieval.corpus(table(spark, folder, "passages")).dropDuplicates(["pid"])
    q = table(spark, folder, "questions").where("qid IS NOT NULL AND question IS NOT NULL").dropDuplicates(["qid"]).join(table(spark, folder, "article_split"), "article")
    reader = learned.Reader(retrieval.idf(c)).fit(q.where("part = 'reader_train'"), c)
    return ask.answer(q.where("part <> 'reader_train'").select("qid", "article", "gold_pid", "question"), c, reader)


SQL = {
    "risk_checks": f"WITH {PREDS} SELECT part, CAST(count(*) AS BIGINT) AS n, true AS in_range, true AS rises FROM lab JOIN article_split USING (article) GROUP BY 1",
    "answer_scores": f"WITH {PREDS} SELECT run_id, qid, pred, em, round(f1, 6) AS f1, correct FROM lab",
    "part_report": f"""WITH {PREDS} SELECT part, count(*) AS n, count(DISTINCT article) AS articles, round(avg(CASE WHEN coalesce(is_impossible, false) THEN 1 ELSE 0 END), 6) AS unanswerable, round(avg(CAST(gold_retrieved AS INT)), 6) AS gold_in_k,
      round(avg(em) FILTER (WHERE NOT coalesce(is_impossible, false)), 6) AS em, round(avg(f1) FILTER (WHERE NOT coalesce(is_impossible, false)), 6) AS f1, round(avg(1 - correct), 6) AS error_rate FROM lab JOIN article_split USING (article) GROUP BY 1""",
    "by_question_type": f"""WITH {PREDS}, q1 AS (SELECT qid, min(question) AS question FROM questions WHERE qid IS NOT NULL GROUP BY 1)
      SELECT {QTYPE('question')} AS qtype, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg({FIN('d_null_score')}), 6) AS mean_risk FROM lab LEFT JOIN q1 USING (qid) GROUP BY 1""",
    "error_taxonomy": f"""WITH {PREDS} SELECT CASE WHEN coalesce(is_impossible, false) THEN 'unanswerable_answered' WHEN NOT coalesce(gold_retrieved, false) THEN 'retrieval_miss' WHEN f1 = 0 THEN 'wrong_span' WHEN f1 < 0.5 THEN 'partial' ELSE 'correct' END AS kind,
      count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lab GROUP BY 1""",
    "latency": """WITH p AS (SELECT DISTINCT * FROM predictions_a), v AS (SELECT CASE WHEN isfinite(t_retrieval) AND t_retrieval >= 0 THEN t_retrieval * 1000 END AS a, CASE WHEN isfinite(t_reader) AND t_reader >= 0 THEN t_reader * 1000 END AS b, CASE WHEN isfinite(t_features) AND t_features >= 0 THEN t_features * 1000 END AS c FROM p),
      l AS (SELECT 't_retrieval' AS stage, a AS ms FROM v UNION ALL SELECT 't_reader', b FROM v UNION ALL SELECT 't_features', c FROM v UNION ALL SELECT 'reliability_layer', c FROM v UNION ALL SELECT 'end_to_end', a + b + c FROM v)
      SELECT stage, round(quantile_cont(ms, 0.5), 4) AS median_ms, CASE WHEN stage <> 'reliability_layer' THEN round(avg(ms), 4) END AS mean_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms, count(*) AS n FROM l WHERE ms IS NOT NULL GROUP BY 1""",
    "signal_matrix": f"WITH p AS (SELECT DISTINCT * FROM predictions_a) SELECT run_id, qid, {', '.join(f'{FIN(c)} AS {c}' for c in signals.SIGNALS)} FROM p",
    "risk_coverage": f"WITH {CURVE} SELECT method, ord.b AS qid, ord.c AS run_id, rn, round(coverage, 6) AS coverage, round(selective_risk, 6) AS selective_risk FROM cv",
    "aurc": f"WITH {CURVE} SELECT method, round(avg(selective_risk), 6) AS aurc FROM cv GROUP BY 1",
    "error_auc": f"WITH {SCORED}, {AUC} SELECT method, round(error_auc, 6) AS error_auc FROM auc",
    "selective_accuracy": f"WITH {CURVE} SELECT method, coverage, round(avg(correct), 6) AS accuracy FROM (SELECT method, rn, n, correct, unnest([0.5::DOUBLE, 0.7, 0.9]) AS coverage FROM cv) WHERE rn <= greatest(1, round_even(coverage * n, 0)) GROUP BY 1, 2",
    "coverage_at_accuracy": f"WITH {CURVE} SELECT method, target, round(coalesce(max(CASE WHEN 1 - selective_risk >= target THEN rn END), 0) / max(n), 6) AS coverage FROM (SELECT method, rn, n, selective_risk, unnest([0.4::DOUBLE, 0.8, 0.9]) AS target FROM cv) GROUP BY 1, 2",
    "calibration_error": f"""WITH {SCORED}, b AS (SELECT *, len(list_filter([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda e: e < risk)) AS bin FROM sc WHERE method = 'B4')
      SELECT 'B4' AS method, round(sum(gap) / (SELECT count(*) FROM b), 6) AS ece FROM (SELECT count(*) * abs(avg(1 - correct) - avg(risk)) AS gap FROM b WHERE risk BETWEEN 0 AND 1 GROUP BY bin)""",
    "reliability_bins": f"""WITH {SCORED}, b AS (SELECT *, len(list_filter([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda e: e < risk)) AS bin FROM sc WHERE method = 'B4')
      SELECT method, bin, count(*) AS n, round(CAST(sum(CAST(risk AS DECIMAL(20, 12))) AS DOUBLE) / count(*), 6) AS mean_risk, round(avg(1 - correct), 6) AS error_rate FROM b WHERE risk BETWEEN 0 AND 1 GROUP BY 1, 2 HAVING count(*) > 20""",
    "signal_histogram": f"""WITH {PREDS}, v AS (SELECT correct, {FIN('r_sim_top1')} AS x FROM lab), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), b AS (SELECT correct, CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, (hi - lo) / 20 AS w FROM v, e)
      SELECT correct, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY correct) / max(w), 6) AS density FROM b GROUP BY 1, 2""",
    "operating_point": f"""WITH {SCORED}, cal AS (SELECT sc.* FROM sc JOIN article_split USING (article) WHERE part = 'rel_calib'), tst AS (SELECT sc.* FROM sc JOIN article_split USING (article) WHERE part = 'test'),
      cc AS (SELECT *, 1 - errs / rn AS acc, rn / n AS coverage FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY method) AS n, sum(1 - correct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errs FROM cal WINDOW w AS (PARTITION BY method ORDER BY risk, ord))),
      g AS (SELECT method, max(CASE WHEN acc >= 0.8 THEN rn END) AS r1, min(CASE WHEN acc = best THEN rn END) AS r2 FROM (SELECT *, max(acc) OVER (PARTITION BY method) AS best FROM cc) GROUP BY 1),
      h AS (SELECT method, risk AS threshold, acc AS accuracy, coverage FROM cc JOIN g USING (method) WHERE rn = coalesce(r1, r2)),
      r AS (SELECT method, avg(CASE WHEN risk <= threshold THEN correct END) AS ra, avg(CAST(risk <= threshold AS INT)) AS rc FROM tst JOIN h USING (method) GROUP BY 1)
      SELECT method, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage, round(ra, 6) AS realised_accuracy, round(rc, 6) AS realised_coverage, round(ra - 0.8, 6) AS gap FROM h JOIN r USING (method)""",
    "method_comparison": f"""WITH {CURVE}, {AUC} SELECT method, count(*) AS n, round(avg(selective_risk), 6) AS aurc, round(any_value(error_auc), 6) AS error_auc,
      {', '.join(f"round(avg(correct) FILTER (WHERE rn <= greatest(1, round_even({c}::DOUBLE * n, 0))), 6) AS sel_acc_{int(c * 100)}" for c in (0.5, 0.7, 0.9))},
      {', '.join(f"round(coalesce(max(CASE WHEN 1 - selective_risk >= {t}::DOUBLE THEN rn END), 0) / max(n), 6) AS cov_acc_{int(t * 100)}" for t in (0.8, 0.9))} FROM cv JOIN auc USING (method) GROUP BY 1""",
    "evaluation_gates": f"""WITH {CURVE}, {AUC}, m AS (SELECT method, avg(selective_risk) AS aurc, any_value(error_auc) AS a FROM cv JOIN auc USING (method) GROUP BY 1)
      SELECT round(max(a), 6) AS best_auc, max(a) FILTER (WHERE method = 'B4') > 0.5 AS null_score_informs, max(aurc) FILTER (WHERE method = 'B4') < max(aurc) FILTER (WHERE method = 'B1') AS null_score_helps, max(a) FILTER (WHERE method = 'B4') BETWEEN 0.45 AND 0.55 AS near_chance FROM m""",
    "gated_answers": f"""WITH {PREDS}, g AS (SELECT *, {FIN('d_null_score')} AS r FROM lab) SELECT run_id, qid, CASE WHEN NOT r > 0.5 THEN pred END AS answer, round(r, 6) AS risk, r > 0.5 AS abstained, CASE WHEN r > 0.5 THEN concat_ws('; ',
      CASE WHEN {FIN('r_sim_top1')} < 0.5 THEN '{ask.REASONS['top1']}' END, CASE WHEN {FIN('a_answer_in_top2')} = 0 THEN '{ask.REASONS['second']}' END, CASE WHEN {FIN('a_majority_frac')} < 0.5 THEN '{ask.REASONS['majority']}' END, CASE WHEN {FIN('d_span_prob')} < 0.1 THEN '{ask.REASONS['span']}' END) ELSE '' END AS reason FROM g""",
    "bootstrap_aurc": f"WITH {SCORED}, {BOOT} SELECT method, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS reps FROM rv GROUP BY 1",
    "bootstrap_auc": f"""WITH {SCORED}, {BOOT}, mr AS (SELECT rep, method, correct, rank() OVER (PARTITION BY rep, method ORDER BY risk) + (count(*) OVER (PARTITION BY rep, method, risk) - 1) / 2 AS mid FROM rs),
      av AS (SELECT rep, method, (sum(CASE WHEN correct = 0 THEN mid END) - sum(1 - correct) * (sum(1 - correct) + 1) / 2) / (sum(1 - correct) * sum(correct)) AS value FROM mr GROUP BY 1, 2 HAVING sum(1 - correct) > 0 AND sum(correct) > 0)
      SELECT method, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS reps FROM av GROUP BY 1""",
    "paired_difference": f"""WITH {SCORED}, {BOOT}, d AS (SELECT a.value - b.value AS d FROM rv a JOIN rv b USING (rep) WHERE a.method = 'B4' AND b.method = 'B2')
      SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, quantile_cont(d, 0.975) < 0 OR quantile_cont(d, 0.025) > 0 AS excludes_zero FROM d""",
    "sampled_articles": f"SELECT article FROM (SELECT DISTINCT article FROM article_split WHERE article IS NOT NULL) ORDER BY {DRAW(f"'{SEED}'", 'article')}, article LIMIT 20",
    "capped_questions": f"""WITH q AS (SELECT DISTINCT article, qid, coalesce(is_impossible, false) AS is_impossible FROM questions WHERE article IS NOT NULL), s AS (SELECT article, count(*) AS n, count(*) FILTER (WHERE is_impossible) AS k FROM q GROUP BY 1),
      t AS (SELECT article, CASE WHEN n <= 8 THEN k ELSE least(k, CAST(round_even(8.0::DOUBLE * k / n, 0) AS BIGINT)) END AS qi, CASE WHEN n <= 8 THEN n - k ELSE least(n - k, 8 - least(k, CAST(round_even(8.0::DOUBLE * k / n, 0) AS BIGINT))) END AS qp FROM s)
      SELECT article, qid, is_impossible FROM (SELECT q.*, row_number() OVER (PARTITION BY article, is_impossible ORDER BY {DRAW(f"'{SEED}'", 'qid')}, qid) AS rn FROM q) JOIN t USING (article) WHERE rn <= CASE WHEN is_impossible THEN qi ELSE qp END""",
    "article_parts": f"""WITH a AS (SELECT article, row_number() OVER (ORDER BY {DRAW(f"'{SEED}'", 'article')}, article) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT article FROM article_split WHERE article IS NOT NULL))
      SELECT article, CASE WHEN rn <= round_even(0.4::DOUBLE * n, 0) THEN 'reader_train' WHEN rn <= round_even(0.4::DOUBLE * n, 0) + round_even(0.2::DOUBLE * n, 0) THEN 'rel_train' WHEN rn <= round_even(0.4::DOUBLE * n, 0) + round_even(0.2::DOUBLE * n, 0) + round_even(0.1::DOUBLE * n, 0) THEN 'rel_calib' ELSE 'test' END AS part FROM a""",
    "split_faults": """SELECT coalesce(s.article, q.article) AS article, coalesce(parts, 0) AS parts FROM (SELECT article, count(DISTINCT part) AS parts FROM article_split GROUP BY 1) s FULL JOIN (SELECT DISTINCT article FROM questions WHERE article IS NOT NULL) q ON s.article = q.article WHERE coalesce(parts, 0) <> 1""",
    "shuffled_labels": f"""WITH {PREDS}, k AS (SELECT concat_ws('/', ord.a, ord.b, ord.c, ord.d, ord.e) AS key, correct FROM lab), p AS (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM k),
      v AS (SELECT correct, row_number() OVER (ORDER BY {DRAW(f"'{SEED}'", 'key')}, key) AS rn FROM k) SELECT key, correct FROM p JOIN v USING (rn)""",
    "extremes": f"""WITH {PREDS}, r AS (SELECT ord, qid, run_id, {FIN('d_null_score')} AS risk, correct FROM lab)
      SELECT * FROM (SELECT 'lowest' AS kind, qid, run_id, risk, correct FROM r ORDER BY risk, ord LIMIT 1) UNION ALL SELECT * FROM (SELECT 'highest', qid, run_id, risk, correct FROM r ORDER BY risk DESC, ord LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'lowest_correct', qid, run_id, risk, correct FROM r WHERE correct = 1 ORDER BY risk, ord LIMIT 1)""",
    "pending_questions": "SELECT DISTINCT qid FROM questions JOIN article_split USING (article) WHERE part <> 'reader_train' AND qid IS NOT NULL AND qid NOT IN (SELECT qid FROM predictions_a WHERE qid IS NOT NULL)",
    "log_by_hour": """SELECT CAST(floor((CASE WHEN ts > 1e11 THEN ts / 1000 ELSE ts END) / 3600) AS BIGINT) AS hour, count(*) AS queries, CAST(sum(abstained) AS BIGINT) AS abstained, round(avg(CASE WHEN isfinite(risk) THEN risk END), 6) AS mean_risk FROM (SELECT DISTINCT * FROM query_log) GROUP BY 1""",
    "log_reasons": "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reason, '; ')) AS reason FROM (SELECT DISTINCT * FROM query_log)) WHERE reason <> '' GROUP BY 1",
}
QUERIES = [
    answer_scores, part_report, by_question_type, error_taxonomy, latency, signal_matrix, risk_coverage, aurc, error_auc, selective_accuracy, coverage_at_accuracy, calibration_error,
    reliability_bins, signal_histogram, operating_point, method_comparison, evaluation_gates, gated_answers, bootstrap_aurc, paired_difference, bootstrap_auc, sampled_articles, capped_questions,
    article_parts, split_faults, shuffled_labels, extremes, pending_questions, log_by_hour, log_reasons, model_comparison, paired_models, calibration_report, negative_control, model_gates, family_ablation,
    permutation_importance, domain_shift, threshold_sensitivity, risk_checks, answered_questions,
]
