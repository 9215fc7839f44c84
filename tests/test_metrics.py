"""Hand-computed cases of the selective-prediction metrics."""

import math

import pytest

from quillspan.operators import metrics, resample

RISK, CORRECT = [0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9], [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0]


def scored(spark, risk, correct, method="m"):
    rows = [(method, k, f"a{k % 2}", float(r), float(c)) for k, (r, c) in enumerate(zip(risk, correct))]
    return spark.createDataFrame(rows, "method string, ord int, article string, risk double, correct double")


def test_curve(spark):
    rows = metrics.risk_coverage(scored(spark, RISK, CORRECT)).orderBy("rn").collect()
    assert [r["selective_risk"] for r in rows] == pytest.approx([0, 1 / 2, 1 / 3, 1 / 4, 2 / 5, 1 / 3, 3 / 7])
    assert [r["coverage"] for r in rows] == pytest.approx([k / 7 for k in range(1, 8)])


def test_aurc(spark):
    curve = metrics.risk_coverage(scored(spark, RISK, CORRECT))
    assert metrics.aurc(curve).first()["aurc"] == pytest.approx((1 / 2 + 1 / 3 + 1 / 4 + 2 / 5 + 1 / 3 + 3 / 7) / 7)


def test_accuracies_and_coverages(spark):
    curve = metrics.risk_coverage(scored(spark, RISK, CORRECT))
    kept = {r["coverage"]: r["accuracy"] for r in metrics.selective_accuracy(curve, [0.3, 0.5, 1.0]).collect()}
    assert kept == {0.3: pytest.approx(1 / 2), 0.5: pytest.approx(3 / 4), 1.0: pytest.approx(4 / 7)}  # 3.5 answers round to 4
    six = metrics.risk_coverage(scored(spark, RISK[:5], CORRECT[:5]))
    assert metrics.selective_accuracy(six, [0.5]).first()["accuracy"] == pytest.approx(1 / 2)  # 2.5 answers round to 2
    reached = {r["target"]: r["coverage"] for r in metrics.coverage_at_accuracy(curve, [0.6, 0.75, 1.0]).collect()}
    assert reached == {0.6: pytest.approx(6 / 7), 0.75: pytest.approx(4 / 7), 1.0: pytest.approx(1 / 7)}
    never = metrics.coverage_at_accuracy(metrics.risk_coverage(scored(spark, [3, 4, 5], [0, 0, 0])), [0.2]).first()
    assert never["coverage"] == 0


@pytest.mark.parametrize(("risk", "correct", "auc"), [(RISK, CORRECT, 2 / 3), ([1 - r for r in RISK], CORRECT, 1 / 3), ([2, 7, 1, 8], [1, 0, 1, 0], 1.0), ([3, 3, 3], [0, 1, 0], 0.5)])
def test_auc(spark, risk, correct, auc):
    assert metrics.error_auc(scored(spark, risk, correct)).first()["error_auc"] == pytest.approx(auc)


def test_auc_of_one_class(spark):
    assert math.isnan(metrics.error_auc(scored(spark, RISK, [1] * 7)).first()["error_auc"])


def test_ece(spark):
    """Ten answers at 0.15 of which one is wrong, twenty at 0.85 of which fifteen are."""
    rows = scored(spark, [0.15] * 10 + [0.85] * 20, [0.0] + [1.0] * 9 + [0.0] * 15 + [1.0] * 5)
    assert metrics.ece(rows).first()["ece"] == pytest.approx((10 * 0.05 + 20 * 0.10) / 30)
    bins = {r["bin"]: (r["n"], r["mean_risk"], r["error_rate"]) for r in metrics.reliability_bins(rows).collect()}
    assert bins == {1: (10, 0.15, 0.1), 8: (20, 0.85, 0.75)}


def test_ties_keep_input_order(spark):
    rows = metrics.risk_coverage(scored(spark, [0.5] * 6, [0, 1, 1, 0, 1, 1])).orderBy("rn").collect()
    assert [r["ord"] for r in rows] == list(range(6))


def test_threshold(spark):
    curve = metrics.risk_coverage(scored(spark, RISK, CORRECT))
    assert tuple(metrics.choose_threshold(curve, 0.75).first())[1:] == pytest.approx((0.5, 3 / 4, 4 / 7))
    worse = metrics.risk_coverage(scored(spark, [0.3, 0.6, 0.7, 0.9], [0, 1, 1, 0]))
    chosen = metrics.choose_threshold(worse, 0.9)
    assert tuple(chosen.first())[1:] == pytest.approx((0.7, 2 / 3, 3 / 4))
    seen = metrics.at_threshold(scored(spark, [0.1, 0.7, 0.8], [1, 0, 1]), chosen, 0.9).first()
    assert (seen["realised_accuracy"], seen["realised_coverage"], seen["gap"]) == pytest.approx((0.5, 2 / 3, -0.4))


def test_gates(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    got = metrics.gates(
        one("error_auc double", (0.47,)), one("part string, error_rate double", ("test", 0.5), ("rel_calib", 0.9)), one("method string, error_auc double", ("B4", 0.6), ("P1", 0.72)),
        one("pair string, mean double, high double", ("P1-B5", -0.1, -0.05), ("P1-B4", -0.1, 0.02)), one("ece_after double, gap double", (0.05, 0.2)), one("stage string, median_ms double", ("reliability_layer", 3.0)),
    )
    assert {r["gate"]: r["passed"] for r in got.collect()} == {"G0": True, "G1": True, "G2": True, "G3": True, "G4": False, "G5": False, "G6": True}
    metrics.require_control(one("error_auc double, passed boolean", (0.5, True)))
    with pytest.raises(RuntimeError):
        metrics.require_control(one("error_auc double, passed boolean", (0.7, False)))


def test_large_groups_are_ranked_in_ranges(spark):
    from quillspan.operators.skew import running

    rows = scored(spark, [k % 7 for k in range(500)], [k % 3 == 0 for k in range(500)])
    a = running(rows, ["method"], ["risk", "ord"], {"s": "correct"}).orderBy("rn").collect()
    b = running(rows, ["method"], ["risk", "ord"], {"s": "correct"}, most=10, parts=8).orderBy("rn").collect()
    assert [(r["ord"], r["rn"], r["n"], r["s"]) for r in a] == [(r["ord"], r["rn"], r["n"], r["s"]) for r in b]


def test_resampling_is_the_same_for_all_metrics_and_partitions(spark):
    rows = scored(spark, [k % 11 for k in range(60)], [k % 3 > 0 for k in range(60)])
    one = sorted(map(tuple, resample.draws(rows, "article", 5, 3).collect()))
    assert one == sorted(map(tuple, resample.draws(rows.repartition(7), "article", 5, 3).collect())) and len(one) == 10
    got = resample.bootstrap_interval(rows, "aurc", 20, 1).first()
    assert got["low"] <= got["high"] and got["reps"] == 20
    own = resample.bootstrap_statistic(rows, lambda f: 1 - f["correct"].mean(), 4, 1)
    assert own.count() == 4


def test_paired_difference_with_itself_is_zero(spark):
    rows = scored(spark, [k % 11 for k in range(60)], [k % 3 > 0 for k in range(60)], "a")
    both = rows.unionByName(scored(spark, [k % 11 for k in range(60)], [k % 3 > 0 for k in range(60)], "b"))
    got = resample.paired_difference(both, "a", "b", "aurc", 10, 1).first()
    assert (got["mean"], got["low"], got["high"], got["excludes_zero"]) == (0, 0, 0, False)


def test_histogram_and_intervals(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "x double").withColumn("g", F.lit("g"))
    out = metrics.histogram(rows, ["g"], "x", 4).orderBy("bin").collect()
    assert [(r["bin"], r["n"], r["density"]) for r in out] == [(0, 1, 1.0), (2, 1, 1.0), (3, 2, 2.0)]
    signs = spark.createDataFrame([(-2.0, -1.0), (-1.0, 1.0)], "lo double, hi double").select(metrics.excludes_zero(F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in signs] == [True, False]


@pytest.mark.parametrize("metric", ["aurc", "auc"])
def test_replicates_of_small_and_large_tables_agree(spark, metric):
    rows = [("m" if k % 2 else "k", k, f"a{k % 5}" if k % 17 else None, float(k * 7 % 6), float(k % 3 > 0)) for k in range(120)]
    frame = spark.createDataFrame(rows, "method string, ord int, article string, risk double, correct double")
    one = {(r["rep"], r["method"]): r["value"] for r in resample.replicate_metric(frame, metric, 12, 5).collect()}
    two = {(r["rep"], r["method"]): r["value"] for r in resample.replicate_metric(frame, metric, 12, 5, small=0).collect()}
    assert one.keys() == two.keys() and len(one) == 24 and all(one[k] == pytest.approx(two[k]) for k in one)


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_replicates_equal_drawn_rows_and_dont_pass_the_driver(spark, monkeypatch, small):
    """Ties of right and wrong answers, articles drawn several times, methods that lack articles: as the drawn rows written out have it."""
    import hashlib

    rows = [(m, k, f"a{k % 5}" if k % 17 else None, float(k * 7 % 4) if m == "t" else k / 7, float(k % 3 > 0)) for k in range(120) for m in ("t", "u") if m == "t" or k % 5]
    frame = spark.createDataFrame(rows, "method string, ord int, article string, risk double, correct double").repartition(3)
    drawn: dict = {}
    for r in resample.resample(frame, 6, 5).collect():
        drawn.setdefault((r["rep"], r["method"]), []).append((r["risk"], r["ord"]["slot"], r["ord"]["ord"], r["correct"]))
    collected = []
    monkeypatch.setattr(type(frame), "toPandas", lambda self: collected.append(self) or pytest.fail("rows pass the driver"))
    area = {(r["rep"], r["method"]): r["value"] for r in resample.replicate_metric(frame, "aurc", 6, 5, small=small).collect()}
    auc = {(r["rep"], r["method"]): r["value"] for r in resample.replicate_metric(frame, "auc", 6, 5, small=small).collect()}
    assert area.keys() == drawn.keys() == auc.keys() and not collected
    for key, own in drawn.items():
        own.sort()
        wrong = [1 - r[3] for r in own]
        assert area[key] == pytest.approx(sum(sum(wrong[: k + 1]) / (k + 1) for k in range(len(own))) / len(own), abs=1e-12)
        bad, good = ([r[0] for r in own if r[3] == c] for c in (0, 1))
        assert auc[key] == pytest.approx(sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good), abs=1e-12)
    assert resample._draws_of(5, 3, 1234).tolist() == [int(hashlib.md5(f"5|3|{s}".encode()).hexdigest()[:8], 16) % 1234 for s in range(1234)]
