"""One ranking from several differently scaled scores (problem 6).

Method: median rank aggregation. An item's rank in each score is the middle of
the places it shares with equal ones; items are ordered by the weighted median of
their ranks, then the mean rank, then the identifier. Only the order of a score
counts, never its scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.skew import lookup, split_ranks
from quillspan.session import materialize

SCORES = ("dense", "bm25", "hybrid")
#: Neighbouring places whose items meet in one step of the comparison for majority winners.
CHUNK = 64


def _ordered(score: str) -> Column:
    """The score as a number to rank by: null, NaN and infinite ones are lower than any number and equal."""
    c = F.col(score).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(float("-inf"))).otherwise(c + F.lit(0.0))


def rank_items(items: DataFrame, group: str, item: str, scores: tuple[str, ...] = SCORES, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``group, item, n, median_rank, mean_rank`` and a ``rank_<score>`` for each score (1 is best; equal scores share the middle of their places).

    Rows equal in all columns count once. An item that stands several times in a
    group has the best of its scores. Rows without group or item belong to no
    ranking. A score that is equal for all items ranks them all alike.
    """
    weights = weights or (1.0,) * len(scores)
    best = items.select(group, item, *[_ordered(s).alias(f"_{s}") for s in scores]).where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*[F.max(f"_{s}").alias(f"_{s}") for s in scores])
    ranked = split_ranks(best, group, [f"_{s}" for s in scores])
    for s in scores:
        ranked = ranked.withColumn(f"rank_{s}", F.col(f"above__{s}") + (F.col(f"ties__{s}") + 1) / 2)
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"rank_{s}").alias("r"), F.lit(float(w)).alias("w")) for s, w in zip(scores, weights)]))
    half = sum(weights) / 2
    walk = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("r")),
        lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.when(a["r"].isNull() & (a["seen"] + x["w"] >= half), x["r"]).otherwise(a["r"]).alias("r")),
    )
    mean = sum((F.col(f"rank_{s}") * w for s, w in zip(scores, weights)), F.lit(0.0)) / sum(weights)
    return ranked.select(group, item, "n", *[f"rank_{s}" for s in scores], walk["r"].alias("median_rank"), mean.alias("mean_rank"))


def fused(ranked: DataFrame, group: str, item: str, most: int = 200_000, ranges: int = 512) -> DataFrame:
    """Add ``place``, from 1 on, the order of the items of each group.

    In groups of more than ``most`` items the median ranks, which lie between 1
    and n, are cut into ranges that are numbered by themselves and start where
    the ranges before end.
    """
    order = [F.col("median_rank"), F.col("mean_rank"), F.col(item)]
    span = F.when(F.col("n") > most, F.floor(F.col("median_rank") * ranges / (F.col("n") + 1))).otherwise(F.lit(0))
    cut = ranked.withColumn("_range", span)
    sizes = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    return inside.join(starts.hint("merge"), [group, "_range"]).withColumn("place", (F.col("_base") + F.col("_at")).cast("long")).drop("_range", "_base", "_at")


def majority_winners(placed: DataFrame, group: str, item: str, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """``group, item``: the item that is higher than each other item of its group on most of the scores, where there is one.

    ``placed`` is the order by median rank (:func:`fused`), and it says who can
    win: another item is as high or higher than a winner in a minority of the
    scores. So the winner's ranks, less 1, sum up to at most lose (n - 1), and those
    from the median on, as large as the median at least, bound the median itself.
    These items, for three scores at most the upper half by median rank, meet in
    the order of their places, CHUNK neighbouring places at a time: the better of
    two goes on, and a winner survives every meeting. The one survivor is then held
    against all items of its group.
    """
    need = len(scores) // 2 + 1
    lose = len(scores) - need  # scores in which another item may be as high or higher
    r = [f"rank_{s}" for s in scores]
    placed = materialize(placed.select(group, item, "n", "place", "median_rank", "mean_rank", *r), "placed")
    room = F.lit(lose) * (F.col("n") - 1)
    upper = len(scores) - (len(scores) + 1) // 2 + 1  # ranks from the (lower) median on
    possible = (F.col("median_rank") <= 1 + room / upper + 1e-9) & (F.col("mean_rank") <= 1 + room / len(scores) + 1e-9)

    def beats(x: Column, y: Column) -> Column:
        return sum((F.when(x[c] < y[c], 1).otherwise(0) for c in r), F.lit(0)) >= need

    me = F.struct((F.col("place") - 1).alias("at"), F.col(item).alias("item"), "n", *r)
    left = placed.where(possible).select(group, me.alias("x"))
    most = placed.agg(F.max("n").alias("m")).first()["m"] or 0
    kind = left.schema["x"].dataType
    fold = F.aggregate(F.array_sort("xs"), F.lit(None).cast(kind), lambda best, x: F.when(best.isNull() | beats(x, best), x).when(beats(best, x), best))
    width = 1
    while width < most or width == 1:
        width *= CHUNK  # survivors of CHUNK neighbouring chunks are CHUNK at most
        left = left.groupBy(group, F.floor(F.col("x.at") / width).alias("_c")).agg(F.collect_list("x").alias("xs")).select(group, fold.alias("x")).where("x IS NOT NULL")
    left = materialize(left.select(group, F.col("x.n").alias("_n"), F.col("x").alias("w")), "survivors")
    against = lookup(placed.select(group, item, *r), left, group, "_n").where(F.col(item) != F.col("w.item"))
    lost = against.where(~beats(F.col("w"), F.struct(*r))).select(group).distinct()
    return left.select(group, F.col("w.item").alias(item)).join(lost.hint("merge"), group, "left_anti")
