"""Percentiles of very large numeric columns with bounded error (problem 5).

Method: merging centroid digests. Sorted values are clustered under a size
function that allows large clusters in the middle and small ones at the ends;
digests merge by clustering their centroids again; a second pass over the values
counts the exact rank of each estimate and so certifies its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import materialize

#: Clusters that a digest has at most, about; digests merged by one task for one group.
COMPRESSION, FAN_IN = 200, 64


def cluster(means: np.ndarray, weights: np.ndarray, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Cluster values (or centroids) with weights; at most about ``compression`` clusters.

    The scale is k(q) = (compression / 2 pi) asin(2 q - 1): a cluster may span at
    most one unit of it, so that clusters near q are of size sqrt(q (1 - q)).
    """
    if len(means) <= 1:
        return means, weights
    order = np.lexsort((weights, means))
    means, weights = means[order], weights[order]
    total = weights.sum()
    q = np.minimum(1.0, np.cumsum(weights) / total)
    k = compression / (2 * np.pi) * np.arcsin(2 * q - 1)
    starts, i, n = [0], 0, len(means)
    low = -compression / 4
    while True:
        i = max(int(np.searchsorted(k, low + 1, side="right")), i + 1)
        if i >= n:
            break
        starts.append(i)
        low = k[i - 1]
    at = np.array(starts)
    w = np.add.reduceat(weights, at)
    return np.add.reduceat(means * weights, at) / w, w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at rank q (n - 1), interpolated between the centres of the clusters."""
    if len(means) == 0:
        return float("nan")
    centre = np.cumsum(weights) - weights / 2 - 0.5
    return float(np.interp(q * (weights.sum() - 1), np.r_[0, centre, weights.sum() - 1], np.r_[low, means, high]))


def usable(column: str):
    """Null, NaN, infinite and negative values don't count."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


def digests(values: DataFrame, keys: list[str], value: str, compression: int = COMPRESSION) -> DataFrame:
    """The keys and ``n, low, high, means, weights``: one digest a group, built in each partition and merged in a tree.

    ``values`` holds numbers that are not null, NaN or infinite. Keys may be null.
    No task merges more than FAN_IN digests of a group, however large the group.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys).schema.fields]
    schema = ", ".join([*fields, "bucket long", "n long", "low double", "high double", "means array<double>", "weights array<double>"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}
        for frame in batches:
            for key, own in frame.groupby(keys, dropna=False, sort=False)[value]:
                x = own.to_numpy(dtype=np.float64)
                key = tuple(None if pd.isna(k) else k for k in key)
                old = held.get(key)
                means, weights = (x, np.ones(len(x))) if old is None else (np.r_[old[3], x], np.r_[old[4], np.ones(len(x))])
                if len(means) > 4 * compression:
                    means, weights = cluster(means, weights, compression)
                held[key] = [len(x) + (old[0] if old else 0), min(x.min(), old[1] if old else np.inf), max(x.max(), old[2] if old else -np.inf), means, weights]
        rows = []
        for key, (n, low, high, means, weights) in held.items():
            means, weights = cluster(means, weights, compression)
            rows.append((*key, here, n, low, high, means, weights))
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "bucket", "n", "low", "high", "means", "weights"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        means, weights = cluster(np.concatenate(frame["means"].to_list()), np.concatenate(frame["weights"].to_list()), compression)
        first = frame.iloc[0]
        return pd.DataFrame([(*[first[k] for k in keys], first["bucket"], frame["n"].sum(), frame["low"].min(), frame["high"].max(), means, weights)], columns=[*keys, "bucket", "n", "low", "high", "means", "weights"])

    parts = max(1, values.rdd.getNumPartitions())
    out = values.select(*keys, value).mapInPandas(build, schema)
    while True:
        parts = -(-parts // FAN_IN)
        out = out.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy(*keys, "bucket").applyInPandas(merge, schema)
        if parts <= 1:
            return out.drop("bucket")


def merge_digests(parts: DataFrame, keys: list[str], compression: int = COMPRESSION, fan_in: int = FAN_IN) -> DataFrame:
    """Combine digests of separate runs or days into one a group of ``keys``, FAN_IN at a time."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema.fields]
    schema = ", ".join([*fields, "bucket long", "n long", "low double", "high double", "means array<double>", "weights array<double>"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        means, weights = cluster(np.concatenate(frame["means"].to_list()), np.concatenate(frame["weights"].to_list()), compression)
        first = frame.iloc[0]
        return pd.DataFrame([(*[first[k] for k in keys], first["bucket"], frame["n"].sum(), frame["low"].min(), frame["high"].max(), means, weights)], columns=[*keys, "bucket", "n", "low", "high", "means", "weights"])

    columns = [*keys, "bucket", "n", "low", "high", "means", "weights"]
    most = parts.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"] or 1
    spread = max(1, -(-most // fan_in))
    out = parts.withColumn("bucket", F.pmod(F.xxhash64("means", "n", "low", "high"), F.lit(spread)))
    while True:
        out = out.select(*columns).groupBy(*keys, "bucket").applyInPandas(merge, schema)
        if spread <= 1:
            return out.drop("bucket")
        spread = -(-spread // fan_in)
        out = out.withColumn("bucket", F.pmod(F.col("bucket"), F.lit(spread)))


def estimates(made: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """The keys, ``n``, ``q`` and ``estimate`` for each quantile asked for."""

    @F.pandas_udf("array<double>")
    def values(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([[quantile(np.asarray(m), np.asarray(w), a, b, q) for q in quantiles] for m, w, a, b in zip(means, weights, low, high)])

    wide = made.select(*keys, "n", values("means", "weights", "low", "high").alias("_v"))
    asked = F.array(*map(F.lit, quantiles))
    return wide.select(*keys, "n", F.explode(F.arrays_zip(asked.alias("q"), F.col("_v").alias("estimate"))).alias("_z")).select(*keys, "n", F.col("_z.q").alias("q"), F.col("_z.estimate").alias("estimate"))


def certify(values: DataFrame, keys: list[str], value: str, estimated: DataFrame) -> DataFrame:
    """Add to each estimate what the values say: ``below, upto`` (how many are less, and at most it), the nearest values
    ``floor`` (at most) and ``ceiling`` (at least), and ``rank_error``, the distance of its rank from q (n - 1), as a share of n.

    The second pass: estimates are few a group, and come to the values as one array a group.
    """
    wide = estimated.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "estimate", "n"))).alias("_e"))
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    rows = values.select(*keys, F.col(value).alias("_x")).alias("v").join(wide.alias("e"), on).select("v.*", F.explode("e._e").alias("_e"))
    x, e = F.col("_x"), F.col("_e.estimate")
    counted = rows.groupBy(*keys, F.col("_e.q").alias("q"), F.col("_e.estimate").alias("estimate"), F.col("_e.n").alias("n")).agg(
        F.count_if(x < e).alias("below"), F.count_if(x <= e).alias("upto"), F.max(F.when(x <= e, x)).alias("floor"), F.min(F.when(x >= e, x)).alias("ceiling")
    )
    target = F.col("q") * (F.col("n") - 1)
    # ranks below .. upto - 1 are the estimate's own if it is a value, else it lies between ranks below - 1 and below
    first = F.when(F.col("upto") > F.col("below"), F.col("below")).otherwise(F.col("below") - 1)
    last = F.when(F.col("upto") > F.col("below"), F.col("upto") - 1).otherwise(F.col("below"))
    error = F.greatest(first - target, target - last, F.lit(0.0)) / F.col("n")
    return counted.withColumn("rank_error", error)


def exact(values: DataFrame, keys: list[str], value: str, certified: DataFrame) -> DataFrame:
    """The keys, ``q`` and ``exact``: the quantile itself (between neighbouring ranks interpolated), for each certified estimate.

    Only values between the estimate and the ranks wanted are looked at: with the
    certified rank error e these are e n values. They are counted by value first,
    so repeated values don't gather.
    """
    target = F.col("q") * (F.col("n") - 1)
    asked = certified.select(*keys, "q", "estimate", "below", "floor", "ceiling", F.floor(target).alias("lo"), F.ceil(target).alias("hi"), target.alias("target"))
    # an estimate between the two ranks wanted has their values next to it
    between = (F.col("lo") < F.col("below")) & (F.col("hi") >= F.col("below"))
    known = asked.where(between).select(*keys, "q", (F.col("floor") + (F.col("ceiling") - F.col("floor")) * (F.col("target") - F.col("lo"))).alias("exact"))
    want = asked.where(~between)
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    up = F.col("e.lo") >= F.col("e.below")  # both ranks lie at or above the estimate, else both below
    x = F.col("v._x")
    near = F.when(up, x >= F.col("e.estimate")).otherwise(x < F.col("e.estimate"))
    counted = values.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    rows = counted.alias("v").join(want.alias("e"), on).where(near).select(*[F.col(f"v.{k}") for k in keys], "e.q", "e.lo", "e.hi", "e.target", F.when(up, F.col("e.below")).otherwise(F.lit(0)).alias("_base"), "v._x", "v._n")
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "q").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_to", F.col("_base") + F.sum("_n").over(w) - 1).withColumn("_from", F.col("_to") - F.col("_n") + 1)
    at = lambda r: F.max(F.when((F.col("_from") <= F.col(r)) & (F.col("_to") >= F.col(r)), F.col("_x")))
    both = ranked.groupBy(*keys, "q", "lo", "target").agg(at("lo").alias("_lo"), at("hi").alias("_hi"))
    return both.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("target") - F.col("lo"))).alias("exact")).unionByName(known)


def stage_times(predictions: DataFrame, key: str) -> DataFrame:
    """``key, stage, seconds``: usable times of the three stages, rows equal in all columns once."""
    stages = ["t_retrieval", "t_reader", "t_features"]
    long = predictions.distinct().select(F.col(key).alias("key"), F.expr(f"stack({len(stages)}, {', '.join(f'{s!r}, cast({s} as double)' for s in stages)}) as (stage, seconds)"))
    return long.where(usable("seconds"))


def percentiles(predictions: DataFrame, key: str, quantiles: list[float]) -> DataFrame:
    """Certified percentiles of each stage for each value of ``key``: ``key, stage, q, n, estimate, rank_error`` and the counts."""
    times = materialize(stage_times(predictions, key), "stage-times")
    keys = ["key", "stage"]
    made = materialize(digests(times, keys, "seconds"), "digests")
    return certify(times, keys, "seconds", estimates(made, keys, quantiles))


def heavy_tails(predictions: DataFrame, key: str, factor: float = 4.0) -> DataFrame:
    """``key, stage`` where the 95th percentile is at least ``factor`` times the median.

    Estimates and the values next to them, whose ranks the second pass knows,
    decide where they can; the exact quantiles of the rest are looked up.
    """
    times = materialize(stage_times(predictions, key), "stage-times")
    keys = ["key", "stage"]
    made = materialize(digests(times, keys, "seconds"), "digests")
    certified = materialize(certify(times, keys, "seconds", estimates(made, keys, [0.5, 0.95])), "certified")
    # a quantile lies on the side of the estimate that its rank says; the nearest value there bounds it
    target = F.col("q") * (F.col("n") - 1)
    low = F.when(F.floor(target) >= F.col("below"), F.col("ceiling"))
    high = F.when(F.ceil(target) < F.col("upto"), F.col("floor"))
    bounds = certified.select(*keys, "q", low.alias("low"), high.alias("high"))
    side = bounds.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col(c))).alias(f"{c}{int(q * 100)}") for q in (0.5, 0.95) for c in ("low", "high")])
    yes = F.coalesce(F.col("low95") >= factor * F.col("high50"), F.lit(False))
    no = F.coalesce(F.col("high95") < factor * F.col("low50"), F.lit(False))
    judged = side.select(*keys, F.when(yes, True).when(no, False).alias("heavy"))
    open_ = judged.where("heavy IS NULL").select(*keys)
    match = lambda a: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    left = times.alias("t").join(open_.alias("o"), match("t"), "left_semi")
    asked = certified.alias("c").join(open_.alias("o"), match("c"), "left_semi")
    known = exact(left, keys, "seconds", asked).groupBy(*keys).agg(F.max(F.when(F.col("q") == 0.5, F.col("exact"))).alias("m"), F.max(F.when(F.col("q") == 0.95, F.col("exact"))).alias("p"))
    return judged.where("heavy").select(*keys).unionByName(known.where(F.col("p") >= factor * F.col("m")).select(*keys))


def quantiles(predictions: DataFrame, key: str, asked: list[float]) -> DataFrame:
    """``key, stage, q, n, exact``: the quantiles themselves, found from certified estimates."""
    times = materialize(stage_times(predictions, key), "stage-times")
    keys = ["key", "stage"]
    made = materialize(digests(times, keys, "seconds"), "digests")
    certified = materialize(certify(times, keys, "seconds", estimates(made, keys, asked)), "certified")
    match = [F.col(f"c.{k}").eqNullSafe(F.col(f"x.{k}")) for k in [*keys, "q"]]
    return certified.alias("c").join(exact(times, keys, "seconds", certified).alias("x"), match).select("c.key", "c.stage", "c.q", "c.n", "x.exact")


def combined(predictions: DataFrame, key: str, asked: list[float]) -> DataFrame:
    """``stage, q, n, estimate, rank_error`` over all keys, from digests that were made and written for each key by itself.

    This is how results of separate runs or days are brought together: only their
    digests are merged; the second pass over the values certifies the outcome.
    """
    times = materialize(stage_times(predictions, key).where("key IS NOT NULL"), "stage-times")
    of_runs = materialize(digests(times, ["key", "stage"], "seconds"), "digests")
    merged = materialize(merge_digests(of_runs.drop("key"), ["stage"]), "digests-merged")
    return certify(times, ["stage"], "seconds", estimates(merged, ["stage"], asked)).select("stage", "q", "n", "estimate", "rank_error")
