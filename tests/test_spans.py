"""Tokens, candidates and features against a plain computation."""

import numpy as np
import pytest

from quillspan.functions.text import EDGE_MARKS, STOPWORDS
from quillspan.operators import retrieval as R
from quillspan.operators import spans as S

TEXT = "In 1492, the Old Harbour was built. Marta Ruiz drew it! Was the harbour of 11,119 stones old?"


@pytest.fixture
def toks(spark):
    return S.tokens(spark.createDataFrame([(1, "x", TEXT), (2, "x", ""), (3, "x", "... !!")], "pid long, article string, text string"))


def plain():
    import re

    tokens = re.findall(r"\w+|[^\w\s]", TEXT)
    bad = [t.lower() in STOPWORDS or t in EDGE_MARKS for t in tokens]
    return tokens, bad


def test_tokens(toks):
    rows = toks.where("pid = 1").orderBy("pos").collect()
    tokens, bad = plain()
    assert [r["token"] for r in rows] == tokens and [r["is_edge"] for r in rows] == bad
    assert [r["is_num"] for r in rows[:3]] == [0, 1, 1] and rows[-1]["sent_id"] == 2 and rows[0]["n"] == len(tokens)


def test_candidates(toks):
    tokens, bad = plain()
    want = {(s, n) for s in range(len(tokens)) for n in range(1, 9) if s + n <= len(tokens) and not bad[s] and not bad[s + n - 1]}
    got = [(r["start"], r["len"]) for r in S.candidates(toks).where("pid = 1").collect()]
    assert set(got) == want and len(got) == len(want)
    assert S.candidates(toks).where("pid > 1").count() == 0


def test_features(spark, toks):
    q = spark.createDataFrame([("q", "x", 1, "Who drew the old harbour?")], "qid string, article string, gold_pid long, question string")
    corpus = spark.createDataFrame([(1, "x", TEXT)], "pid long, article string, text string")
    got = {(r["start"], r["len"]): r for r in S.features(S.question_words(q), toks, R.idf(corpus), S.candidates(toks)).collect()}
    tokens, _ = plain()
    low = [t.lower() for t in tokens]
    inq = np.array([t in {"who", "drew", "old", "harbour"} for t in low], float)
    at = np.flatnonzero(inq)
    for (s, n), r in got.items():
        e = s + n
        assert r["f_len"] == n
        assert r["f_inq"] == pytest.approx(inq[s:e].mean())
        assert r["f_cap"] == pytest.approx(np.mean([t[0].isupper() for t in tokens[s:e]]))
        assert r["f_dist"] == np.abs(at - s).min()
        a, b = max(s - 4, 0), min(e + 4, len(tokens))
        assert r["f_left"] == pytest.approx(inq[a:s].sum() / max(s - a, 1))
        assert r["f_right"] == pytest.approx(inq[e:b].sum() / max(b - e, 1))
        assert r["f_cap_wanted"] == pytest.approx(r["f_cap"]) and r["f_num_wanted"] == 0
        assert r["f_rel"] == pytest.approx(s / len(tokens))
    assert len(got) == S.candidates(toks).where("pid = 1").count()  # three sentences: all are kept


def test_only_the_best_sentences_are_kept(spark, toks):
    q = spark.createDataFrame([("q", "x", 1, "Who drew it?")], "qid string, article string, gold_pid long, question string")
    corpus = spark.createDataFrame([(1, "x", TEXT)], "pid long, article string, text string")
    rows = S.features(S.question_words(q), toks, R.idf(corpus), S.candidates(toks), top_sentences=1).collect()
    assert rows and {r["f_sent_rank"] for r in rows} == {0.0}


def test_surface_texts(spark):
    """Spans are cut from the text: thousands, decimals, hyphens, odd blanks and marks outside ASCII stay as written."""
    text = "  The  wall of 11,119 stones — 3.5 metres\nhigh — is the well-known\u00a0 O'Hara wall 👍🏽 ok."
    p = spark.createDataFrame([(1, "x", text), (2, "x", "")], "pid long, article string, text string")
    rows = S.span_texts(S.candidates(S.tokens(p)), p).collect()
    answers = {r["answer"] for r in rows}
    assert {"11,119 stones", "3.5 metres\nhigh", "well-known", "well-known\u00a0 O'Hara wall", "11,119", "ok"} <= answers
    assert all(text[r["c0"] : r["c1"]] == r["answer"] for r in rows)


def test_gold_with_thousands_is_found(spark, tmp_path):
    from quillspan.plans import corpus_queries as C

    spark.createDataFrame([(1, "a", 0, "The wall has 11,119 stones and a well-known gate.")], "pid long, article string, para_idx int, text string").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([("q1", "a", 1, "How many stones?", ["11,119"], False), ("q2", "a", 1, "What gate?", ["Well-known gate"], False)], "qid string, article string, gold_pid long, question string, answers array<string>, is_impossible boolean").write.parquet(f"{tmp_path}/questions.parquet")
    assert {(r["qid"], r["spans"]) for r in C.gold_spans(spark, str(tmp_path)).collect()} == {("q1", 1), ("q2", 1)}


@pytest.mark.parametrize(("query", "most"), [("span_features", 1), ("training_spans", 1), ("gold_spans", 0)])
def test_no_table_of_tokens_or_spans_is_broadcast(spark, monkeypatch, query, most):
    """What may be broadcast are the heavy terms of the lookup; Spark's guesses of the other sizes are far too low."""
    from quillspan.operators import learned
    from quillspan.plans import corpus_queries as C

    monkeypatch.setattr(learned, "materialize", lambda rows, name: rows)
    plan = getattr(C, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 * most and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan
