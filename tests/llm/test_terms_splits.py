"""Distinctive terms, spanning forests and grouped splits."""

import math
import random
from collections import Counter

import pytest
import regex

from quillspan.llm import distinctive, forest, groupsplit


def test_scores_and_found(spark):
    pick = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)] + ["état", "мост", "x_1"]
    ps = [(i, " ".join(pick.choices(vocabulary, k=pick.randrange(1, 30)))) for i in range(40)] + [(90, None), (91, " ... "), (None, "lost words"), (92, "solo solo solo")]
    ps += ps[:5]
    qs = [(f"q{i}", " ".join(pick.choices(vocabulary, k=5)).upper()) for i in range(30)] + [("n", None)]
    p = spark.createDataFrame([(*r, "z", 1) for r in ps], "pid long, text string, term string, df int")
    q = spark.createDataFrame([(*r, "z") for r in qs], "qid string, question string, kind string")
    tf = {}
    for kind, rows in (("passage", set(ps)), ("question", set(qs))):
        for k, t in rows:
            if k is not None and t is not None:
                tf[kind, str(k)] = Counter(regex.findall(r"[\p{L}\p{N}_]+", t.lower()))
    df = Counter(w for (kind, _), c in tf.items() if kind == "passage" for w in c)
    cf = sum(tf.values(), Counter())
    total = sum(cf.values())
    scores = distinctive.term_scores(p, q)
    got = {(r["kind"], r["record_key"], r["term"]): r for r in scores.collect()}
    assert set(got) == {(*k, w) for k, c in tf.items() for w in c if df[w] >= 2}
    for (kind, key, w), r in got.items():
        c = tf[kind, key]
        pc = cf[w] / total
        pd = (c[w] + distinctive.MU * pc) / (sum(c.values()) + distinctive.MU)
        assert r["score"] == pytest.approx(pd * math.log(pd / pc)) and r["df"] == df[w]
    found = {tuple(r) for r in distinctive.rare_shared(scores).collect()}
    assert found == {(*k, w) for k, c in tf.items() for w in c if 2 <= df[w] <= 8 and (k[0] == "question" or c[w] >= 3)}


def test_scores_of_nothing(spark):
    p, q = spark.createDataFrame([], "pid long, text string"), spark.createDataFrame([], "qid string, question string")
    assert distinctive.term_scores(p, q).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_forest(spark, seed):
    pick = random.Random(seed)
    edges = [(f"v{pick.randrange(60):02}", f"v{pick.randrange(60):02}") for _ in range(45)] + [("c0", f"c{k}") for k in range(1, 12)] + [(f"p{k:02}", f"p{k + 1:02}") for k in range(20)] + [("a", "a"), (None, "b"), ("v01", "v01")]
    labels, trees = forest.spanning_forest(spark.createDataFrame(edges + edges[:9], "a string, b string"))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    least = {}
    for v in parent:
        least[find(v)] = min(v, least.get(find(v), v))
    assert {r["v"]: r["root"] for r in labels.collect()} == {v: least[find(v)] for v in parent}
    kept = {(r["a"], r["b"]) for r in trees.collect()}
    assert len(kept) == len(parent) - len(least) and kept <= {(min(e), max(e)) for e in edges if None not in e}


def test_forest_of_nothing(spark):
    labels, trees = forest.spanning_forest(spark.createDataFrame([], "a string, b string"))
    assert labels.count() == 0 and trees.count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Old_Mill", "old-mill", True), ("Ｏｌｄ　Ｍｉｌｌ", " Old  Mill", True), ("Vale&#x27;s Mill", "Vale’s Mill", True), ("A%20%26%20B", "A & B", True), ("Café", "Café", True), ("​Old Mill", "Old Mill", True),
        ("Straße", "STRASSE", True), ("A–B", "A-B", True), ("A &amp;amp; B", "A & B", True), ("Old Mill", "Old Mill 2", False), ("Old Mill", "Old Mill (novel)", False), ("कि", "के", False), ("100%", "100", False), ("", "x", False),
    ],
)
def test_titles(a, b, same):
    assert (groupsplit.title_key(a) == groupsplit.title_key(b)) is same


def test_split_keeps_articles_together(spark):
    pick = random.Random(6)
    names = [f"Art {k}" for k in range(80)]
    ways = [lambda s: s, str.upper, lambda s: s.replace(" ", "_"), lambda s: f" {s}"]
    ps = [(i, pick.choice(ways)(pick.choice(names)) if pick.random() < 0.9 else None) for i in range(400)] + [(1000 + i, "Big One") for i in range(200)]
    qs = [(f"q{i}", pick.choice(ways)(pick.choice(names)) if pick.random() < 0.8 else None, pick.choice([None, 5000, pick.randrange(400)]) if pick.random() < 0.1 else None) for i in range(300)]
    p = spark.createDataFrame([(*r, "x") for r in ps], "pid long, article string, part string")
    q = spark.createDataFrame([(*r, "x") for r in qs], "qid string, article string, gold_pid long, root string")
    s = p.select("article").unionAll(q.select("article")).where("article IS NOT NULL").distinct()
    roots, _ = groupsplit.article_roots(s, p, q)
    shares = [("a", 0.4), ("b", 0.2), ("c", 0.1), ("d", 0.3)]
    got = groupsplit.assign(p, q, roots, shares).collect()
    assert len(got) == len(set(ps)) + len(set(qs))
    by_title, part_of_pid, n = {}, {}, Counter()
    for r in got:
        n[r["part"]] += 1
        if r["article"]:
            assert by_title.setdefault(groupsplit.title_key(r["article"]), r["part"]) == r["part"]
        if r["kind"] == "passage":
            part_of_pid[int(r["record_key"])] = r["part"]
    for r in got:
        if r["kind"] == "question":
            gold = next(x[2] for x in qs if x[0] == r["record_key"])
            if gold in part_of_pid:
                assert r["part"] == part_of_pid[gold]
    for part, share in shares:
        assert abs(n[part] / len(got) - share) < 0.08
    pairs = {tuple(r) for r in groupsplit.same_article(s, roots).collect()}
    strings = sorted(r["article"] for r in s.collect())
    assert all((a, b) in pairs for a in strings for b in strings if a < b and groupsplit.title_key(a) == groupsplit.title_key(b))


def test_split_of_nothing(spark):
    p, q = spark.createDataFrame([], "pid long, article string"), spark.createDataFrame([], "qid string, article string, gold_pid long")
    roots, _ = groupsplit.article_roots(p.select("article"), p, q)
    assert groupsplit.assign(p, q, roots, [("a", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        groupsplit.deal(spark.createDataFrame([("x", 1)], "unit string, size long"), [("a", 0.0)])
