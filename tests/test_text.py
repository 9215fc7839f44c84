"""Answers, question types and tokens on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T


@pytest.mark.parametrize(
    ("pred", "golds", "impossible", "em", "f1", "correct"),
    [
        ("abomasum", ["The abomasum"], False, 1.0, 1.0, True),
        ("11,119", ["11,119,872"], False, 0.0, 0.0, False),
        ("", [""], False, 1.0, 1.0, False),
        (None, [], True, 0.0, 0.0, True),
        ("  ", None, True, 0.0, 0.0, True),
        ("x", None, True, 0.0, 0.0, False),
        ("x x b", ["x b b"], False, 0.0, 2 / 3, True),
        ("big big dog", ["big dog dog cat"], False, 0.0, 4 / 7, True),
        ("dog", [None, "cat"], False, 0.0, 0.0, False),
        ("the", ["an"], False, 1.0, 1.0, True),
    ],
)
def test_answers(spark, pred, golds, impossible, em, f1, correct):
    row = spark.createDataFrame([(pred, golds, impossible)], "p string, g array<string>, i boolean")
    got = row.select(T.exact_match(F.col("p"), F.col("g")), T.best_f1(F.col("p"), F.col("g")), T.is_correct(F.col("p"), F.col("g"), F.col("i"))).first()
    assert got[0] == em and got[1] == pytest.approx(f1) and got[2] is correct


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("How many ships?", "how_many"), ("how much is it", "how_many"), ("And how many ships", "how_many"), ("What did who see", "who"), ("Whose is it", "who"),
        ("In the year when it fell", "when"), ("Which one", "which"), ("Why not", "why"), ("Wherever", "where"), ("How so", "how"), ("Did it", "other"), (None, "other"), ("", "other"),
        ("It was a very long sentence about ships and what", "other"),
    ],
)
def test_question_types(spark, question, kind):
    assert spark.createDataFrame([(question,)], "q string").select(T.question_type(F.col("q"))).first()[0] == kind


def test_words_are_unicode(spark):
    row = spark.createDataFrame([("Étre naïve_x, 12!",)], "t string")
    assert row.select(T.words(F.col("t"))).first()[0] == ["étre", "naïve_x", "12"]
    assert row.select(T.reader_tokens(F.col("t"))).first()[0] == ["Étre", "naïve_x", ",", "12", "!"]
    assert sorted(row.select(T.content_words(F.lit("Who saw the saw of a x"))).first()[0]) == ["saw", "who"]


def test_normalisation_removes_articles_as_words_only(spark):
    row = spark.createDataFrame([("The étheé, an A-team  theatre",)], "t string")
    assert row.select(T.normalize_answer(F.col("t"))).first()[0] == "étheé ateam theatre"


def test_draws_are_md5(spark):
    import hashlib

    got = spark.range(1).select(T.hash_draw(F.lit("7"), F.lit("x"))).first()[0]
    assert got == int(hashlib.md5(b"7|x").hexdigest()[:8], 16)


def test_finite(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.5,)], "x double").select(T.finite_or_zero(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0, 0, 0, -1.5]
