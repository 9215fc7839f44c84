"""Retrieval on five toy passages, and on nothing."""

import math
from collections import Counter

import pytest

from quillspan.operators import retrieval as R

ROWS = [
    (0, "art0", 0, "The cat sat on the mat near the door."), (1, "art0", 1, "The dog slept on the warm rug."), (2, "art1", 0, "Rockets fly to space using fuel."),
    (3, "art1", 1, "The moon orbits the earth slowly."), (4, "art2", 0, "Bread needs flour, water and yeast."),
]


@pytest.fixture
def passages(spark):
    return R.corpus(spark.createDataFrame(ROWS, "pid long, article string, para_idx int, text string"))


def ask(spark, text, article=None, gold=None):
    return R.askable(spark.createDataFrame([("q", article, gold, text)], "qid string, article string, gold_pid long, question string"))


def test_bm25_formula(spark, passages):
    docs = {r[0]: R_words(r[3]) for r in ROWS}
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(5 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    avg = sum(map(len, docs.values())) / 5
    want = {}
    for pid, d in docs.items():
        tf = Counter(d)
        s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ["what", "sat", "on", "the", "the", "mat"])
        if s:
            want[pid] = round(s, 6)
    got = {r["pid"]: r["score"] for r in R.bm25(passages, ask(spark, "What sat on the the mat")).collect()}
    assert got == pytest.approx(want)


def R_words(text):
    import re

    return re.findall(r"\w+", text.lower())


def test_top_is_descending_and_stable(spark, passages):
    q = ask(spark, "what sat on the mat")
    rows = R.hybrid(passages, q, 3).orderBy("rank").collect()
    scores = [r["hybrid"] for r in rows]
    assert len(rows) == 3 and scores == sorted(scores, reverse=True) and rows[0]["pid"] == 0
    again = R.hybrid(passages, q, 3).orderBy("rank").collect()
    assert rows == again


def test_siblings_are_hidden_and_gold_is_not(spark, passages):
    q = ask(spark, "the dog sat on the mat", "art0", 0)
    assert {r["pid"] for r in R.bm25(passages, q).collect()} == {0, 3}
    assert {r["pid"] for r in R.bm25(passages, q, masked=False).collect()} == {0, 1, 3}


def test_nearest_equals_brute_force(spark, passages):
    import numpy as np

    q = ask(spark, "the dog on the rug and the mat")
    held, asked, k = R.latent_vectors(passages, q, dims=3)
    got = [(r["pid"], r["score"]) for r in R.nearest(held, asked, 2).orderBy("rank").collect()]
    v = np.array(asked.first()["vec"])
    want = sorted(((r["pid"], round(float(v @ np.array(r["vec"])), 6)) for r in held.collect()), key=lambda x: (-x[1], x[0]))[:2]
    assert k >= 1 and [p for p, _ in got] == [p for p, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_hybrid_is_dense_in_the_latent_space(spark):
    import inspect

    import numpy as np

    texts = ["car engine wheel", "automobile engine wheel", "automobile wheel road", "car road engine", "bread flour water", "bread flour yeast", "yeast water bread", "--- 7"]
    p = R.corpus(spark.createDataFrame([(k, f"art{k}", x) for k, x in enumerate(texts)], "pid long, article string, text string"))
    q = ask(spark, "car")
    got = {r["pid"]: r for r in R.hybrid(p, q, 10, dims=2).collect()}
    held, asked, _ = R.latent_vectors(p, q, dims=2)
    v = np.array(asked.first()["vec"])
    want = {r["pid"]: float(v @ np.array(r["vec"])) for r in held.collect()} | {7: 0.0}
    assert {k: r["dense"] for k, r in got.items()} == pytest.approx(want, abs=1e-5)
    # passage 2 shares no word with the question, but its topic
    assert got[2]["bm25"] == got[4]["bm25"] == pytest.approx(0, abs=1e-6) and got[2]["hybrid"] > got[4]["hybrid"] + 0.2
    low, high = min(want.values()), max(want.values())
    assert got[2]["hybrid"] == pytest.approx(0.5 * (want[2] - low) / (high - low), abs=1e-4)
    assert inspect.signature(R.hybrid).parameters["dims"].default == inspect.signature(R.latent_vectors).parameters["dims"].default == 256


def test_empty_tables(spark):
    none = R.corpus(spark.createDataFrame([], "pid long, article string, text string"))
    assert R.bm25(none, ask(spark, "anything")).count() == 0
    marks = R.corpus(spark.createDataFrame([(1, None, " ... "), (2, None, None)], "pid long, article string, text string"))
    assert marks.count() == 0
