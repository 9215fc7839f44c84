"""Nested JSON, round trips, configuration, splits and samples."""

import json

import pytest

from quillspan.operators import resample
from quillspan.sources import qa_json


@pytest.fixture
def raw(tmp_path):
    def qa(k, answers=None, **more):
        return {"id": f"q{k}", "question": f"What is {k}?", **({} if answers is None else {"answers": [{"text": a} for a in answers]}), **more}

    data = [
        {"title": "B", "paragraphs": [{"context": "b0", "qas": [qa(1, ["y", "x", "y"]), qa(2, [], is_impossible=True)]}, {"context": "", "qas": []}]},
        {"title": "A", "paragraphs": [{"context": "a0", "qas": [qa(3)]}, {"context": " ...", "qas": [qa(4, ["z"], is_impossible=False)]}]},
    ]
    path = tmp_path / "articles.json"
    path.write_text(json.dumps({"data": data}))
    return str(path)


def test_flatten(spark, raw, tmp_path):
    passages, questions = qa_json.build_corpus(spark, raw)
    assert [tuple(r) for r in passages.orderBy("pid").collect()] == [(0, "A", 0, "a0"), (1, "A", 1, " ..."), (2, "B", 0, "b0"), (3, "B", 1, "")]
    rows = {r["qid"]: r for r in questions.collect()}
    assert rows["q1"]["answers"] == ["x", "y"] and rows["q1"]["gold_pid"] == 2 and rows["q2"]["is_impossible"] and rows["q3"]["answers"] == [] and rows["q3"]["is_impossible"] is False
    qa_json.save_corpus(passages, questions, str(tmp_path / "c"))
    p, q = qa_json.load_corpus(spark, str(tmp_path / "c"))
    assert sorted(p.collect()) == sorted(passages.collect()) and q.count() == 4
    assert qa_json.build_corpus(spark, raw, n_articles=1, max_questions=1)[1].count() == 1


def test_prediction_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"qid": "a", "pred": "x"}\n{"qid": "b", "pr')
    assert [r["qid"] for r in qa_json.read_predictions(spark, str(path)).collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed"):
        qa_json.read_predictions(spark, str(path), tolerant=False).collect()


def test_reports_and_checksums(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    qa_json.write_csv(rows, str(tmp_path / "t"))
    assert qa_json.read_csv(spark, str(tmp_path / "t"), "k int, v string").collect() == rows.collect()
    (tmp_path / "f").write_bytes(b"abc")
    assert qa_json.checksums(spark, str(tmp_path / "f")).first()["checksum"] == "ba7816bf8f01cfea"


def test_config(tmp_path):
    text = "seed: 7\ndata:\n  path: 'a#b'  # here\n  on: true\n  off: null\nsplits:\n  a: 0.5\n  b: 0.5\nlist: [1, 2.5, x]\n"
    path = tmp_path / "c.yaml"
    path.write_text(text)
    got = qa_json.load_config(path, ("seed", "data", "splits"))
    assert got == {"seed": 7, "data": {"path": "a#b", "on": True, "off": None}, "splits": {"a": 0.5, "b": 0.5}, "list": [1, 2.5, "x"]}
    with pytest.raises(ValueError, match="missing"):
        qa_json.load_config(path)
    path.write_text(text.replace("b: 0.5", "b: 0.4"))
    with pytest.raises(ValueError, match="sum"):
        qa_json.load_config(path, ("seed",))


@pytest.mark.parametrize(("n", "sizes"), [(120, [48, 24, 12, 36]), (60, [24, 12, 6, 18])])
def test_split(spark, n, sizes):
    articles = spark.createDataFrame([(f"art{k}",) for k in range(n)], "article string")
    fractions = dict(zip(resample.PARTS, (0.4, 0.2, 0.1, 0.3)))
    split = resample.split_articles(articles, fractions, 20260814)
    counts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    assert [counts[p] for p in resample.PARTS] == sizes
    assert resample.split_faults(split, articles).count() == 0
    assert sorted(split.collect()) == sorted(resample.split_articles(articles.repartition(5), fractions, 20260814).collect())
    with pytest.raises(ValueError):
        resample.split_articles(articles.limit(3), fractions, 1)


def test_cap_keeps_the_share(spark):
    rows = spark.createDataFrame([("a", f"q{k}", k < 6) for k in range(20)] + [("b", "z", None)], "article string, qid string, is_impossible boolean")
    got = resample.cap_questions(rows, 10, 1)
    assert got.where("article = 'a'").count() == 10 and got.where("article = 'a' AND is_impossible").count() == 3 and got.where("article = 'b'").count() == 1


def test_shuffle_keeps_values(spark):
    rows = spark.createDataFrame([(f"k{i:02}", i) for i in range(50)], "key string, v int")
    got = sorted(resample.shuffled(rows, "v", ["key"], 3).collect())
    assert sorted(r["v"] for r in got) == list(range(50)) and [r["v"] for r in got] != list(range(50))
