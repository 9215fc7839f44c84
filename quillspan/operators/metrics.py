"""Selective-prediction analytics over a long table of scored answers.

``scored`` has ``method, ord, article, risk, correct``: a higher risk means more
likely wrong, ``correct`` is 1.0 or 0.0, ``ord`` is the input order that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.skew import running


def risk_coverage(scored: DataFrame) -> DataFrame:
    """``method, ord, risk, correct, rn, coverage, selective_risk``: the error rate among the rn least risky answers."""
    ranked = running(scored.withColumn("_e", 1 - F.col("correct")), ["method"], ["risk", "ord"], {"errors": "_e"})
    return ranked.select("method", "ord", "article", "risk", "correct", "rn", "n", (F.col("rn") / F.col("n")).alias("coverage"), (F.col("errors") / F.col("rn")).alias("selective_risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """The mean of the curve; lower is better."""
    return curve.groupBy("method").agg(F.avg("selective_risk").alias("aurc"))


def error_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve of the risk for being wrong, ties averaged; NaN if all answers are right or all wrong.

    Equal risks are counted first, so that the ranking is over different values.
    """
    by = by or ["method"]
    counts = scored.groupBy(*by, "risk").agg(F.sum("correct").alias("_right"), F.sum(1 - F.col("correct")).alias("_wrong"))
    below = running(counts, by, ["risk"], {"_upto": "_right"})
    pairs = below.groupBy(*by).agg(F.sum(F.col("_wrong") * (F.col("_upto") - F.col("_right") / 2)).alias("_won"), F.sum("_right").alias("_r"), F.sum("_wrong").alias("_w"))
    return pairs.select(*by, F.when((F.col("_r") == 0) | (F.col("_w") == 0), F.lit(float("nan"))).otherwise(F.col("_won") / F.nullif(F.col("_r") * F.col("_w"), F.lit(0.0))).alias("error_auc"))


def kept_at(coverage: Column | float, n: Column) -> Column:
    """How many answers a coverage keeps: half-even rounding, at least one."""
    c = F.lit(coverage) if isinstance(coverage, float) else coverage
    return F.greatest(F.lit(1), F.bround(c * n).cast("int"))


def selective_accuracy(curve: DataFrame, coverages: list[float]) -> DataFrame:
    """``method, coverage, accuracy`` of the least risky answers at each coverage."""
    asked = curve.select("method", "rn", "n", "correct", F.explode(F.array(*map(F.lit, coverages))).alias("coverage"))
    return asked.where(F.col("rn") <= kept_at(F.col("coverage"), F.col("n"))).groupBy("method", "coverage").agg(F.avg("correct").alias("accuracy"))


def coverage_at_accuracy(curve: DataFrame, targets: list[float]) -> DataFrame:
    """``method, target, coverage``: the largest coverage whose accuracy reaches the target, else 0."""
    asked = curve.select("method", "rn", "n", "selective_risk", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    reached = F.when(1 - F.col("selective_risk") >= F.col("target"), F.col("rn"))
    return asked.groupBy("method", "target").agg((F.coalesce(F.max(reached), F.lit(0)) / F.max("n")).alias("coverage"))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """The bin of a probability: the first is closed, the others open on the left; null outside 0 to 1."""
    edges = [F.lit(k / bins) for k in range(1, bins + 1)]
    return F.when((p >= 0) & (p <= 1), F.size(F.filter(F.array(*edges), lambda e: e < p)))


def reliability_bins(scored: DataFrame, bins: int = 10, more_than: int = 0) -> DataFrame:
    """``method, bin, n, mean_risk, error_rate`` of the bins with more rows than ``more_than``; risks are summed as decimals, whose sum has no order."""
    rows = scored.withColumn("bin", calibration_bin(F.col("risk"), bins)).where("bin IS NOT NULL")
    out = rows.groupBy("method", "bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("risk").cast("decimal(20,12)")).cast("double") / F.count(F.lit(1))).alias("mean_risk"), F.avg(1 - F.col("correct")).alias("error_rate"))
    return out.where(F.col("n") > more_than)


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps between error rate and mean risk, weighted by all rows."""
    total = scored.groupBy("method").agg(F.count(F.lit(1)).alias("_all"))
    gaps = reliability_bins(scored, bins).groupBy("method").agg(F.sum(F.col("n") * F.abs(F.col("error_rate") - F.col("mean_risk"))).alias("_gap"))
    return total.join(gaps, "method", "left").select("method", (F.coalesce("_gap", F.lit(0.0)) / F.col("_all")).alias("ece"))


def choose_threshold(curve: DataFrame, target: float) -> DataFrame:
    """``method, threshold, accuracy, coverage``: the widest coverage that reaches the target, else the first best accuracy."""
    acc = 1 - F.col("selective_risk")
    best = curve.groupBy("method").agg(
        F.max(F.when(acc >= target, F.struct("rn", "risk", acc.alias("acc"), "coverage"))).alias("reached"),
        F.max(F.struct(acc.alias("acc"), (-F.col("rn")).alias("rn"), "risk", "coverage")).alias("top"),
    )
    pick = lambda c: F.when(F.col("reached").isNotNull(), F.col(f"reached.{c}")).otherwise(F.col(f"top.{c}"))
    return best.select("method", pick("risk").alias("threshold"), pick("acc").alias("accuracy"), pick("coverage").alias("coverage"))


def comparison(scored: DataFrame, coverages: list[float], targets: list[float]) -> DataFrame:
    """A row a method: n, error AUC, AURC, accuracies at coverages and coverages at accuracies."""
    curve = risk_coverage(scored)
    out = curve.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("selective_risk").alias("aurc"))
    out = out.join(error_auc(scored), "method")
    sel = selective_accuracy(curve, coverages).groupBy("method").agg(*[F.max(F.when(F.col("coverage") == c, F.col("accuracy"))).alias(f"sel_acc_{int(c * 100)}") for c in coverages])
    cov = coverage_at_accuracy(curve, targets).groupBy("method").agg(*[F.max(F.when(F.col("target") == t, F.col("coverage"))).alias(f"cov_acc_{int(t * 100)}") for t in targets])
    return out.join(sel, "method").join(cov, "method")


def histogram(values: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """``by, bin, n, density`` of equal-width bins between the least and the greatest value of all rows; the last bin is closed."""
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = values.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counted = rows.withColumn("bin", at.cast("int")).groupBy(*by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counted.select(*by, "bin", "n", F.when(F.col("hi") == F.col("lo"), F.lit(None).cast("double")).otherwise(F.col("n") / total / F.nullif(width, F.lit(0.0))).alias("density"))


def excludes_zero(low: Column, high: Column) -> Column:
    """Does an interval lie on one side of zero?"""
    return (high < 0) | (low > 0)


def with_intervals(scored: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """``method, error_auc_lo, error_auc_hi, aurc_lo, aurc_hi`` over resampled articles, both on the same draws."""
    from quillspan.operators import resample

    auc, area = (resample.bootstrap_interval(scored, m, reps, seed) for m in ("auc", "aurc"))
    return auc.select("method", F.col("low").alias("error_auc_lo"), F.col("high").alias("error_auc_hi")).join(area.select("method", F.col("low").alias("aurc_lo"), F.col("high").alias("aurc_hi")), "method")


def at_threshold(scored: DataFrame, chosen: DataFrame, target: float) -> DataFrame:
    """``method, threshold, accuracy, coverage`` as chosen on one table, and what they come to on ``scored``: ``realised_accuracy, realised_coverage, gap`` to the target."""
    rows = scored.join(F.broadcast(chosen.select("method", "threshold")), "method")  # a row a method
    kept = F.col("risk") <= F.col("threshold")
    seen = rows.groupBy("method").agg(F.avg(F.when(kept, F.col("correct"))).alias("realised_accuracy"), F.avg(kept.cast("int")).alias("realised_coverage"))
    return chosen.join(seen, "method").withColumn("gap", F.col("realised_accuracy") - target)


def require_control(control: DataFrame) -> None:
    """Raise unless the error AUC of a model of shuffled labels lies between 0.45 and 0.55."""
    row = control.first()
    if row is None or not row["passed"]:
        raise RuntimeError(f"the negative control failed: error AUC {row and row['error_auc']}")


def gates(control: DataFrame, parts: DataFrame, compared: DataFrame, paired: DataFrame, calibration: DataFrame, latency: DataFrame) -> DataFrame:
    """``gate, value, passed``: seven checks of an evaluation, from its six tables, of which one row each counts.

    The control's ``error_auc``; the test part's ``error_rate``; the best
    ``error_auc`` of the methods; the upper ends ``high`` of the paired differences
    of P1 with B5 and B4; ``ece_after`` and ``gap``; the reliability layer's median.
    """
    one = [
        control.agg(F.max("error_auc").alias("g0")),
        parts.where("part = 'test'").agg((1 - F.max("error_rate")).alias("g1")),
        compared.agg(F.max("error_auc").alias("g2")),
        paired.agg(*[F.max(F.when(F.col("pair") == f"P1-{m}", F.col(c))).alias(f"g{k}_{c}") for k, m in ((3, "B5"), (4, "B4")) for c in ("mean", "high")]),
        calibration.agg(F.max("ece_after").alias("g5"), F.max("gap").alias("g5_gap")),
        latency.where("stage = 'reliability_layer'").agg(F.max("median_ms").alias("g6")),
    ]
    row = one[0]
    for other in one[1:]:
        row = row.crossJoin(F.broadcast(other))  # one row each
    checks = [
        ("G0", F.col("g0"), F.col("g0").between(0.45, 0.55)), ("G1", F.col("g1"), F.col("g1") >= 0.45), ("G2", F.col("g2"), F.col("g2") >= 0.70),
        ("G3", F.col("g3_mean"), F.col("g3_high") < 0), ("G4", F.col("g4_mean"), F.col("g4_high") < 0),
        ("G5", F.col("g5"), (F.col("g5") < 0.10) & (F.abs("g5_gap") <= 0.03)), ("G6", F.col("g6"), F.col("g6") < 100),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), F.coalesce(p, F.lit(False)).alias("passed")) for n, v, p in checks])
    return row.select(F.explode(each).alias("_g")).select("_g.*")
