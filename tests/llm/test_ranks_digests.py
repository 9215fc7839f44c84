"""Percentile digests and median-rank fusion."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import digest, fusion


@pytest.mark.parametrize("kind", ["even", "skewed", "equal", "two"])
def test_clusters_bound_the_rank_error(kind):
    g = np.random.default_rng(1)
    x = {"even": g.random(50000), "skewed": g.lognormal(0, 3, 50000), "equal": np.ones(50000), "two": np.r_[np.zeros(40000), np.full(10000, 9.0)]}[kind]
    parts = [digest.cluster(p, np.ones(len(p))) for p in np.array_split(x, 37)]
    means, weights = digest.cluster(np.concatenate([m for m, _ in parts]), np.concatenate([w for _, w in parts]))
    assert len(means) <= 2 * digest.COMPRESSION and weights.sum() == pytest.approx(50000)
    for q in (0.01, 0.5, 0.95, 0.999):
        v = digest.quantile(means, weights, x.min(), x.max(), q)
        below, upto = (x < v).mean(), (x <= v).mean()
        assert min(abs(below - q), abs(upto - q), 0 if below <= q <= upto else 1) < 0.01


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, stage string, seconds double")


def test_certified_and_exact(spark):
    pick = random.Random(2)
    rows = [(k, "t", pick.lognormvariate(0, 2)) for k in ("a", "b") for _ in range(3000)] + [("c", "t", 1.0)] * 500 + [(None, "t", float(k)) for k in range(9)] + [("one", "t", 4.0)]
    values = frame(spark, rows).repartition(5)
    keys = ["key", "stage"]
    made = digest.digests(values, keys, "seconds")
    got = digest.certify(values, keys, "seconds", digest.estimates(made, keys, [0.5, 0.95])).collect()
    by = {}
    for k, _, x in rows:
        by.setdefault(k, []).append(x)
    assert len(got) == 2 * len(by)
    for r in got:
        own = np.array(by[r["key"]])
        assert r["n"] == len(own) and r["below"] == (own < r["estimate"]).sum() and r["upto"] == (own <= r["estimate"]).sum()
        assert r["rank_error"] <= (0.01 if len(own) > 100 else 1)
    certified = digest.certify(values, keys, "seconds", digest.estimates(made, keys, [0.5, 0.95]))
    for r in digest.exact(values, keys, "seconds", certified).collect():
        assert r["exact"] == pytest.approx(np.quantile(by[r["key"]], r["q"]))


def test_digests_merge(spark):
    a, b = frame(spark, [("x", "t", float(k)) for k in range(1000)]), frame(spark, [("x", "t", float(k)) for k in range(1000, 3000)])
    keys = ["key", "stage"]
    both = digest.digests(a, keys, "seconds").unionByName(digest.digests(b, keys, "seconds"))
    row = digest.estimates(digest.merge_digests(both, keys), keys, [0.5]).first()
    assert row["n"] == 3000 and abs(row["estimate"] - 1499.5) < 30


def test_heavy_tails(spark):
    pick = random.Random(5)
    runs = {}
    for k in range(14):
        n = pick.choice([1, 2, 5, 40, 300])
        spread = pick.choice([0.3, 0.8, 0.86, 1.0, 2.0])
        runs[f"r{k}"] = [pick.lognormvariate(0, spread) for _ in range(n)]
    runs["edge"] = [1.0] * 19 + [4.0] * 2
    runs["zero"] = [0.0] * 10
    bad = [None, float("nan"), float("inf"), -1.0]
    rows = [(k, x, x, None, "c") for k, xs in runs.items() for x in xs + bad]
    p = spark.createDataFrame(rows, "run_id string, t_retrieval double, t_reader double, t_features double, key string")
    p = p.withColumn("row", F.monotonically_increasing_id())
    got = {(r["key"], r["stage"]) for r in digest.heavy_tails(p, "run_id").collect()}
    want = {(k, s) for k, xs in runs.items() for s in ("t_retrieval", "t_reader") if np.quantile(xs, 0.95) >= 4 * np.quantile(xs, 0.5)}
    assert got == want and want
    assert digest.heavy_tails(p.limit(0), "run_id").count() == 0


SCORES = "qid string, pid long, dense double, bm25 double, hybrid double, n int"


def items(seed):
    pick = random.Random(seed)
    value = lambda: pick.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.0, 2.0, pick.random(), pick.random() * 1e6])
    rows = [(f"q{k}", pid, value(), value(), value(), 1) for k in range(60) for pid in range(pick.choice([1, 2, 3, 7, 22]))]
    rows += rows[:20] + [(None, 1, 1.0, 1.0, 1.0, 1), ("q1", None, 1.0, 1.0, 1.0, 1)]
    rows += [("big", k, float(k * 7 % 300), float(k * 11 % 300), float(k), 1) for k in range(300)] + [("won", k, float(k), float(k), float(-k), 1) for k in range(200)]
    return rows


def number(x):
    return -math.inf if x is None or not math.isfinite(x) else x + 0.0


def test_ranks_and_winners(spark):
    rows = items(3)
    ranked = fusion.rank_items(spark.createDataFrame(rows, SCORES), "qid", "pid")
    by = {}
    for q, p, *s, _ in set(rows):
        if q is not None and p is not None:
            by.setdefault(q, {})[p] = [max(number(x), y) for x, y in zip(s, by.get(q, {}).get(p, [-math.inf] * 3))]
    got = {(r["qid"], r["pid"]): r for r in fusion.fused(ranked, "qid", "pid").collect()}
    assert len(got) == sum(map(len, by.values()))
    for q, own in by.items():
        ranks = {p: [1 + sum(t[k] > s[k] for t in own.values()) + (sum(t[k] == s[k] for t in own.values()) - 1) / 2 for k in range(3)] for p, s in own.items()}
        order = sorted(own, key=lambda p: (sorted(ranks[p])[1], sum(ranks[p]) / 3, p))
        for place, p in enumerate(order, 1):
            assert got[q, p]["place"] == place and got[q, p]["median_rank"] == sorted(ranks[p])[1]
    split = {(r["qid"], r["pid"]): r["place"] for r in fusion.fused(ranked, "qid", "pid", most=10, ranges=8).collect()}
    assert split == {k: r["place"] for k, r in got.items()}
    want = {(q, p) for q, own in by.items() for p, s in own.items() if all(sum(a > b for a, b in zip(s, t)) >= 2 for o, t in own.items() if o != p)}
    placed = fusion.fused(ranked, "qid", "pid")
    assert {tuple(r) for r in fusion.majority_winners(placed, "qid", "pid").collect()} == want and ("won", 199) in want


def test_winner_with_a_poor_median(spark):
    """A winner that is second in every score loses to three others by median rank at one score each."""
    rows = [("q", 0, 2.0, 2.0, 2.0, 1), ("q", 1, 3.0, 1.0, 1.0, 1), ("q", 2, 1.0, 3.0, 1.0, 1), ("q", 3, 1.0, 1.0, 3.0, 1)]
    rows += [("r", k, float(a), float(b), float(c), 1) for k, (a, b, c) in enumerate([(5, 5, 0), (6, 1, 1), (1, 6, 2), (0, 0, 9)])]
    placed = fusion.fused(fusion.rank_items(spark.createDataFrame(rows, SCORES), "qid", "pid"), "qid", "pid")
    assert ("q", 0) in {tuple(r) for r in fusion.majority_winners(placed, "qid", "pid").collect()}


def test_weights(spark):
    rows = spark.createDataFrame([("q", 1, 3.0, 1.0, 1.0, 1), ("q", 2, 2.0, 2.0, 2.0, 1), ("q", 3, 1.0, 3.0, 3.0, 1)], SCORES)
    first = fusion.fused(fusion.rank_items(rows, "qid", "pid", weights=(5.0, 1.0, 1.0)), "qid", "pid").where("place = 1").first()
    assert first["pid"] == 1


def test_no_items(spark):
    none = fusion.rank_items(spark.createDataFrame([], SCORES), "qid", "pid")
    assert fusion.fused(none, "qid", "pid").count() == 0 and fusion.majority_winners(fusion.fused(none, "qid", "pid"), "qid", "pid").count() == 0
