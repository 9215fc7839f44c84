"""Cross-split overlap and near duplicates against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import chars, neardup, overlap, setjoin
from quillspan.session import materialize

from .helpers import grams, plain, similar

ODD = [None, "", "  ", "...!", "ab", "abcd", "ＡＢＣＤ", "Straße 12", "cafés", "日本語の文", "x" * 3000]


def texts(n, seed):
    pick = random.Random(seed)
    words = ["harbour", "temple", "river", "zafo", "kirel", "mode", "old", "the", "of", "painted", "reservoir", "ño", "мост"]
    out = list(ODD)
    while len(out) < n:
        if len(out) > 20 and pick.random() < 0.5:
            t = pick.choice(out) or "seed text"
            k = pick.randrange(len(t) + 1)
            t = t[:k] + pick.choice(["x", "", " very", "1"]) + t[k + pick.randrange(3) :]
        else:
            t = " ".join(pick.choices(words, k=pick.choice([3, 8, 15, 60, 200])))
        out.append(t)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_runs_are_those_of_the_plain_text(text):
    p = plain(text)
    got = chars.runs(chars.plain(text), 4)
    assert len(got) == max(0, len(p) - 3)
    assert len(set(got.tolist())) == len({p[i : i + 4] for i in range(len(p) - 3)})
    wide = chars.runs(chars.plain(text), 24)
    assert len(wide) == max(0, len(p) - 23)


def test_levels():
    assert overlap.level_of(np.array([1, 128, 129, 512, 513, 2048, 2049])).tolist() == [0, 0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("part", [2, 4096])
def test_near_duplicates(spark, part):
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts(220, 1))]
    rows += rows[:30] + [(None, "harbour temple")]
    frame = spark.createDataFrame([(*r, r[0], 1) for r in rows], "qid string, question string, sig string, id int").repartition(3)
    found = neardup.NearDuplicates(frame, "qid", "question", bits=10, part=part)
    got = [(r["key_a"], r["key_b"]) for r in found.pairs().collect()]
    sets = {k: grams(t) for k, t in rows if k}
    want = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    groups = {r["key"]: r for r in found.groups().collect()}
    assert set(groups) == {k for k, s in sets.items() if s}
    for a, b in want:
        assert groups[a]["group"] == groups[b]["group"]
    for k, r in groups.items():
        assert r["copies"] == sum(s == sets[k] for s in sets.values())
        assert r["links"] == len({frozenset(s) for s in sets.values() if s != sets[k] and similar(s, sets[k])})
        assert r["group"] <= k


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "qid string, question string")
    found = neardup.NearDuplicates(none, "qid", "question", bits=10)
    assert found.pairs().count() == 0 and found.groups().count() == 0
    blank = spark.createDataFrame([("a", None), ("b", " "), ("c", "??")], "qid string, question string")
    assert neardup.NearDuplicates(blank, "qid", "question", bits=10).pairs().count() == 0


@pytest.mark.parametrize("part", [2, 4096])
def test_overlap(spark, part):
    pick = random.Random(3)
    arts = {"t1": "reader_train", "t2": "rel_train", "e1": "test", "e2": "rel_calib"}
    some = texts(160, 2)
    names = [*arts, None, "unknown"]
    passages = [(i, pick.choice(names), t) for i, t in enumerate(some)]
    questions = [(f"q{i}", pick.choice(names), t) for i, t in enumerate(texts(120, 5))]
    passages += passages[:10]
    p = spark.createDataFrame([(*r, 1) for r in passages], "pid long, article string, text string, part int")
    q = spark.createDataFrame([(*r, "x") for r in questions], "qid string, article string, question string, kind string")
    s = spark.createDataFrame(list(arts.items()) + [(None, "test")], "article string, part string")
    pairs = overlap.cross_pairs(overlap.records(p, q, s), bits=10, part=part)
    got = {(r["kind"], r["key_t"], r["key_e"]) for r in pairs.collect()}
    want = set()
    for kind, rows in (("passage", passages), ("question", questions)):
        known = [(str(k), arts[a], grams(t)) for k, a, t in rows if a in arts]
        want |= {(kind, a, b) for a, x, g in known for b, y, h in known if x in overlap.TRAINING and y in overlap.EVALUATION and similar(g, h)}
    assert got == want and len(want) > 20
    report = overlap.report(pairs).collect()
    assert sum(r["pairs"] for r in report) == pairs.count()


def test_memberships_and_plans(spark):
    """A row a record with its links; and nothing of the joins is broadcast, however small the tables are."""
    arts = {"t": "reader_train", "e": "test"}
    some = texts(80, 9)
    passages = [(i, "te"[i % 2], t) for i, t in enumerate(some)]
    p = spark.createDataFrame(passages, "pid long, article string, text string")
    q = spark.createDataFrame([], "qid string, article string, question string")
    rows = overlap.records(p, q, spark.createDataFrame(list(arts.items()), "article string, part string"))
    got = {int(r["key"]): r for r in overlap.memberships(rows, bits=10).collect()}
    sets = {i: grams(t) for i, _, t in passages if grams(t)}
    assert set(got) == set(sets)
    for i, r in got.items():
        assert r["copies"] == sum(s == sets[i] for s in sets.values())
        assert r["links"] == len({frozenset(s) for k, s in sets.items() if k % 2 != i % 2 and similar(s, sets[i])})
    pairs = overlap.cross_pairs(rows, bits=10)
    found = neardup.NearDuplicates(p, "pid", "text", bits=10)
    for frame in (pairs, found.pairs(), found.links, found.groups()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlap_of_empty_tables(spark):
    p = spark.createDataFrame([], "pid long, article string, text string")
    q = spark.createDataFrame([], "qid string, article string, question string")
    s = spark.createDataFrame([], "article string, part string")
    assert overlap.cross_pairs(overlap.records(p, q, s), bits=10).count() == 0


def test_overlap_meets_a_bounded_number(spark):
    """What a posting meets doesn't grow with the corpus over a fixed vocabulary, and every pair is found."""
    pick = random.Random(11)
    words = ["harbour", "temple", "river", "zafo", "kirel", "mode", "painted", "reservoir", "census", "lichen", "archivist", "monastery"]
    some = [" ".join(pick.choices(words, k=9)) for _ in range(1600)]
    some[-40:] = [t + " x1" for t in some[:80:2]]

    def classes_of(n):
        p = spark.createDataFrame([(i, "te"[i % 2], t) for i, t in enumerate(some[:n])], "pid long, article string, text string")
        rows = overlap.records(p, spark.createDataFrame([], "qid string, article string, question string"), spark.createDataFrame([("t", "reader_train"), ("e", "test")], "article string, part string"))
        sets = setjoin.text_sets(rows.withColumn("train", F.col("part").isin(*overlap.TRAINING)), ["kind", "key", "train"], "text", space="kind")
        return rows, materialize(setjoin.classes_of(sets, F.max("train").alias("has_t"), F.max(~F.col("train")).alias("has_e")), "test-classes")

    def met_by_a_posting(classes, most):
        known = overlap.crowded_keys(classes, classes.agg({"n": "sum"}).first()[0], 16, most)
        data = np.concatenate([np.frombuffer(r["data"], dtype=overlap.POSTING) for r in overlap.postings(classes, known, 1).collect()])
        trains = data["meta"] >> 23 & 1 > 0
        keys, at = np.unique(data["key"], return_inverse=True)
        return (np.bincount(at[trains], minlength=len(keys)) * np.bincount(at[~trains], minlength=len(keys))).sum() / len(data)

    (_, few), (rows, many) = classes_of(400), classes_of(1600)
    assert met_by_a_posting(many, 1 << 30) > 2.5 * met_by_a_posting(few, 1 << 30)  # keys of one run, as they were before
    bounded = met_by_a_posting(many, 8)
    assert bounded < 8 and bounded < 2 * met_by_a_posting(few, 8)
    got = {(int(r["key_t"]), int(r["key_e"])) for r in overlap.cross_pairs(rows, bits=16, part=8).collect()}
    sets = [grams(t) for t in some]
    assert got == {(a, b) for a in range(0, 1600, 2) for b in range(1, 1600, 2) if similar(sets[a], sets[b])} and len(got) > 20
