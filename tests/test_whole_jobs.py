"""Queries do the whole job: all parts, all rows and the production values."""

import pytest

from quillspan.operators import ask, boosting, learned, resample
from quillspan.plans import corpus_queries as C
from quillspan.plans import evaluation_queries as E

QUESTIONS = "qid string, article string, gold_pid long, question string, answers array<string>, is_impossible boolean"


@pytest.fixture
def folder(spark, tmp_path):
    passages = [(0, "a", 0, "Anna Vale painted the harbour in 1402 near the old river."), (1, "b", 0, "Rockets fly to space with liquid fuel."), (2, "c", 0, "Bread wants flour, water and yeast."), (3, "d", 0, "The moon orbits slowly.")]
    questions = [("q0", "a", 0, "Who painted the harbour?", ["Anna Vale"], False), ("q1", "b", 1, "What do rockets fly with?", ["liquid fuel"], False), ("q2", "c", 2, "zzz", ["flour"], False), ("q3", "d", 3, "What orbits?", [], True)]
    tables = {
        "passages": spark.createDataFrame(passages, "pid long, article string, para_idx int, text string"),
        "questions": spark.createDataFrame(questions, QUESTIONS),
        "article_split": spark.createDataFrame([("a", "reader_train"), ("b", "rel_train"), ("c", "rel_calib"), ("d", "test")], "article string, part string"),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_part_but_the_readers_is_answered(spark, folder, monkeypatch):
    made = []

    class Reader(learned.Reader):
        def fit(self, questions, passages):
            made.append(([r["qid"] for r in questions.collect()], self.per_positive, self.iterations))
            return self

    monkeypatch.setattr(learned, "Reader", Reader)
    monkeypatch.setattr(ask, "answer", lambda questions, passages, reader: questions)
    assert {r["qid"] for r in E.answered_questions(spark, folder).collect()} == {"q1", "q2", "q3"}
    assert made == [(["q0"], 400, 200)]


def test_training_keeps_all_negatives_up_to_400(spark, folder):
    rows = C.training_spans(spark, folder).collect()
    candidates = C.span_features(spark, folder).where("qid = 'q0'").count()
    mine = [r for r in rows if r["qid"] == "q0"]
    assert sum(r["label"] for r in mine) == 1 and len(mine) == candidates > 6
    assert sum(r["weight"] for r in rows if r["label"] == 1) == pytest.approx(sum(r["weight"] for r in rows if r["label"] == 0), abs=1e-3)


def test_bootstraps_have_1000_replicates(spark, monkeypatch):
    asked = []
    real = resample.replicate_metric
    monkeypatch.setattr(resample, "replicate_metric", lambda scored, metric, reps, seed: asked.append(reps) or real(scored, metric, reps, seed))
    small = "/root/testdata/sf0.001"
    assert {r["reps"] for r in E.bootstrap_aurc(spark, small).collect()} == {1000}
    assert len(E.paired_difference(spark, small).collect()) == 1 and asked == [1000, 1000]


def test_risk_models_have_all_rounds_and_shuffles(spark, monkeypatch):
    rounds, dealt, reps = [], [], []
    fit, shuffle, replicate = boosting.fit_models, resample.shuffled_columns, resample.replicate_metric
    monkeypatch.setattr(boosting, "fit_models", lambda rows, specs, **k: rounds.append(k["rounds"]) or fit(rows, specs, **{**k, "rounds": 2}))
    monkeypatch.setattr(resample, "shuffled_columns", lambda rows, columns, key, times, seed: dealt.append((len(columns), times)) or shuffle(rows, columns, key, times, seed))
    monkeypatch.setattr(resample, "replicate_metric", lambda scored, metric, n, seed: reps.append(n) or replicate(scored, metric, 5, seed))
    small = "/root/testdata/sf0.001"
    assert E.model_comparison(spark, small).count() == 6 and E.family_ablation(spark, small).count() == 7
    assert E.domain_shift(spark, small).count() == 6 and E.negative_control(spark, small).count() == 1
    assert set(reps) == {1000}
    assert E.threshold_sensitivity(spark, small).count() == 3 and reps[-1] == 500
    ranked = [r["importance"] for r in E.permutation_importance(spark, small).collect()]
    assert len(ranked) == 16 and ranked == sorted(ranked, reverse=True)
    assert set(rounds) == {200} and dealt == [(16, 10)]


def test_questions_without_a_hit_count_as_not_found(spark, folder):
    got = {r["part"]: (r["n"], r["gold_in_k"]) for r in C.gold_in_top(spark, folder).collect()}
    assert got["rel_calib"] == (1, 0.0) and got["reader_train"] == (1, 1.0)
