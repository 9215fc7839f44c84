"""Deterministic draws: resampling of groups, shuffles, article samples and splits.

All draws are MD5 hashes of a seed and the drawn thing, so that they don't depend
on partitions or engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import hash_draw
from quillspan.operators.skew import running
from quillspan.session import materialize

PARTS = ("reader_train", "rel_train", "rel_calib", "test")


def draws(groups: DataFrame, group: str, reps: int, seed: int) -> DataFrame:
    """``rep, slot, group``: for each replicate as many groups as there are, drawn with replacement."""
    numbered = materialize(_numbered(groups, group), "draws-groups")
    n = numbered.count()
    slots = numbered.select(F.col("_k").alias("slot")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    picked = slots.withColumn("_k", hash_draw(F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")) % max(n, 1))
    return picked.join(numbered.hint("merge"), "_k").select("rep", "slot", group)


def _numbered(groups: DataFrame, group: str) -> DataFrame:
    """``group, _k``: different groups that aren't null, numbered from 0 in their order."""
    names = groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_g", F.lit(0))
    return running(names, ["_g"], [group], {}).select(group, (F.col("rn") - 1).cast("bigint").alias("_k"))


def resample(scored: DataFrame, reps: int, seed: int) -> DataFrame:
    """Replicates of ``scored`` by article: a row for each draw of each article's rows; ``ord`` becomes (slot, ord)."""
    picked = draws(scored, "article", reps, seed)
    return picked.join(scored, "article").select("rep", "method", "article", "risk", "correct", F.struct("slot", "ord").alias("ord"))


#: Scored rows up to which one task packs them, and rows that are packed in one piece.
SMALL, PIECE = 1_000_000, 1 << 16


def _packed_rows(scored: DataFrame, small: int) -> tuple[DataFrame, int]:
    """``method, part, piece, groups, sizes, risks, wrongs`` and the number of articles: the rows in the order of (method, article, ord), in pieces of one method and of few rows each.

    ``groups`` are the numbers of a piece's articles and ``sizes`` their rows in it; all four are arrays as bytes.
    """
    numbered = materialize(_numbered(scored, "article"), "replicates-articles")
    rows = scored.join(numbered.hint("merge"), "article").select("method", "_k", "ord", "risk", "correct")
    keys = ["method", "_k", "ord"]
    dealt = rows.coalesce(1) if rows.count() <= small else rows.repartitionByRange(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            method = table.column("method").combine_chunks().dictionary_encode().indices.to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(method)) + 1).tolist(), len(method)]
            for i, j in zip(ends, ends[1:]):
                for low in range(i, j, PIECE):
                    own = table.slice(low, min(PIECE, j - low))
                    k, risk, correct = (own.column(c).to_numpy() for c in ("_k", "risk", "correct"))
                    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                    arrays = k[first].astype(np.int64), np.diff(np.r_[first, len(k)]).astype(np.int64), risk.astype(np.float64), 1 - correct.astype(np.float64)
                    yield pa.RecordBatch.from_pydict({"method": own.column("method").slice(0, 1).combine_chunks(), "part": [part], "piece": [piece], **{c: [a.tobytes()] for c, a in zip(("groups", "sizes", "risks", "wrongs"), arrays)}})
                    piece += 1

    schema = "method string, part long, piece long, groups binary, sizes binary, risks binary, wrongs binary"
    return materialize(dealt.sortWithinPartitions(*keys).select("method", "_k", "risk", "correct").mapInArrow(pack, schema), "replicates-rows"), numbered.count()


#: The turns and constants of MD5's 64 steps.
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]


def _draws_of(seed: int, rep: int, n: int) -> np.ndarray:
    """The draws of :func:`draws` for the slots below n as numbers of 0 to n - 1: the first four bytes of the MD5 of ``seed|rep|slot``, all slots of one length at once."""
    start, out = np.frombuffer(f"{seed}|{rep}|".encode(), dtype=np.uint8), np.zeros(n, dtype=np.uint32)
    for size in range(1, len(str(n)) + 1):
        slots = np.arange(10 ** (size - 1) if size > 1 else 0, min(n, 10**size), dtype=np.int64)
        if not len(slots):
            continue
        text = np.zeros((len(slots), 64), dtype=np.uint8)
        length = len(start) + size
        text[:, : len(start)] = start
        for k in range(size):
            text[:, len(start) + k] = slots // 10 ** (size - 1 - k) % 10 + ord("0")
        text[:, length], text[:, 56], text[:, 57] = 0x80, length * 8 & 255, length * 8 >> 8
        words = np.ascontiguousarray(text.view("<u4").T)
        first = a, b, c, d = [np.full(len(slots), x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for k in range(64):
            if k < 16:
                mixed, at = d ^ (b & (c ^ d)), k
            elif k < 32:
                mixed, at = c ^ (d & (b ^ c)), (5 * k + 1) % 16
            elif k < 48:
                mixed, at = b ^ c ^ d, (3 * k + 5) % 16
            else:
                mixed, at = c ^ (b | ~d), 7 * k % 16
            mixed = mixed + a + words[at] + np.uint32(_SINES[k])
            a, d, c = d, c, b
            b = b + (mixed << np.uint32(_TURNS[k]) | mixed >> np.uint32(32 - _TURNS[k]))
        out[slots] = (first[0] + a).byteswap()
    return (out % n).astype(np.int32)


def _in_order(code: np.ndarray) -> np.ndarray:
    """The places of small numbers in rising order, equal ones as they stand."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    high = (code >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class _Drawn:
    """One method's rows in the order of (article, ord), from which replicates are drawn. ``pick`` has the article of each slot."""

    def __init__(self, article: np.ndarray, risk: np.ndarray, wrong: np.ndarray, n: int) -> None:
        self.n, self.article, self.wrong = n, article.astype(np.int32), wrong
        self.levels, code = np.unique(risk, return_inverse=True)
        self.code = code.astype(np.int32)
        # only where equal risks are right and wrong does the order of slots tell
        bad, every = np.bincount(self.code, weights=wrong), np.bincount(self.code)
        mixed = (bad > 0) & (bad < every)
        self.order = _in_order(self.code)
        self.sorted = [x[self.order] for x in (self.article, wrong, mixed[self.code])]
        at = np.flatnonzero(mixed[self.code])
        self.count = np.bincount(self.article[at], minlength=n)
        self.starts = np.cumsum(self.count) - self.count
        self.tied = [x[at] for x in (self.code, wrong)]

    def area(self, pick: np.ndarray) -> float | None:
        """The AURC: drawn rows by risk, slot and ord."""
        article, wrong, mixed = self.sorted
        times = np.bincount(pick, minlength=self.n)[article]
        w = np.repeat(wrong, times)
        if not len(w):
            return None
        if len(self.tied[0]):
            size = self.count[pick]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.starts[pick], size)
            code, own = (x[at] for x in self.tied)
            w[np.repeat(mixed, times)] = own[_in_order(code)]  # rows stand in the order of slots, and of ord in a slot
        return float(np.mean(np.cumsum(w) / np.arange(1, len(w) + 1)))

    def auc(self, pick: np.ndarray) -> float | None:
        """The error AUC, equal risks averaged."""
        times = np.bincount(pick, minlength=self.n)[self.article].astype(float)
        bad = np.bincount(self.code, weights=times * self.wrong, minlength=len(self.levels))
        good = np.bincount(self.code, weights=times, minlength=len(self.levels)) - bad
        pairs = good.sum() * bad.sum()
        return float((bad * (np.cumsum(good) - good / 2)).sum() / pairs) if pairs else None


def replicate_metric(scored: DataFrame, metric: str, reps: int, seed: int, small: int = SMALL) -> DataFrame:
    """``rep, method, value`` of AURC or error AUC over resampled articles.

    The rows are packed into arrays (two numbers a row; ``small`` says up to how many
    rows one task does that) and go to each block of replicates; a task computes its
    replicates one after another. Nothing passes the driver, and no replicate's rows
    are ever written. The AURC ranks drawn rows by risk, slot and ord; the AUC doesn't
    depend on the order of equal risks, so that it counts each row as often as its article was drawn.
    """
    packed, n = _packed_rows(scored, small)
    blocks = max(1, min(reps, 2 * scored.sparkSession.sparkContext.defaultParallelism))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("method", "ascending"), ("part", "ascending"), ("piece", "ascending")])
        picks = {rep: _draws_of(seed, rep, n) for rep in range(table.column("_b")[0].as_py(), reps, blocks)}
        names, out = table.column("method").to_pylist(), []
        for m in dict.fromkeys(names):
            own = table.slice(names.index(m), names.count(m))
            groups, sizes, risk, wrong = (np.concatenate([np.frombuffer(b, dtype=kind) for b in own.column(c).to_pylist()]) for c, kind in (("groups", np.int64), ("sizes", np.int64), ("risks", np.float64), ("wrongs", np.float64)))
            held = _Drawn(np.repeat(groups, sizes), risk, wrong, n)
            out += [(rep, m, value) for rep, pick in picks.items() if (value := (held.area if metric == "aurc" else held.auc)(pick)) is not None]
        return pa.table(dict(zip(("rep", "method", "value"), map(list, zip(*out)) if out else ([], [], []))), schema=pa.schema([("rep", pa.int64()), ("method", pa.string()), ("value", pa.float64())]))

    each = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.groupBy("_b").applyInArrow(run, "rep long, method string, value double")


def bootstrap_interval(scored: DataFrame, metric: str, reps: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """``method, low, high, reps``: percentiles of the metric over resampled articles; replicates without a value don't count."""
    values = replicate_metric(scored, metric, reps, seed)
    return values.groupBy("method").agg(F.percentile("value", alpha / 2).alias("low"), F.percentile("value", 1 - alpha / 2).alias("high"), F.count(F.lit(1)).alias("reps"))


def difference(values: DataFrame, a: str, b: str) -> DataFrame:
    """``mean, low, high, excludes_zero`` of the value of method ``a`` less that of ``b`` over replicates (``rep, method, value``)."""
    both = values.groupBy("rep").agg(F.max(F.when(F.col("method") == a, F.col("value"))).alias("x"), F.max(F.when(F.col("method") == b, F.col("value"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    d = F.col("x") - F.col("y")
    out = both.agg(F.avg(d).alias("mean"), F.percentile(d, 0.025).alias("low"), F.percentile(d, 0.975).alias("high"))
    return out.withColumn("excludes_zero", (F.col("high") < 0) | (F.col("low") > 0))


def paired_difference(scored: DataFrame, a: str, b: str, metric: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """``mean, low, high, excludes_zero`` of metric(a) - metric(b) on the same draws."""
    return difference(replicate_metric(scored.where(F.col("method").isin(a, b)), metric, reps, seed), a, b)


def paired_statistic(scored: DataFrame, a: str, b: str, statistic: Callable, reps: int, seed: int) -> DataFrame:
    """The same for any statistic of a pandas frame of one method's rows."""
    values = None
    for m in (a, b):
        one = bootstrap_statistic(scored.where(F.col("method") == m), statistic, reps, seed).withColumn("method", F.lit(m))
        values = one if values is None else values.unionByName(one)
    return difference(values, a, b)


def bootstrap_statistic(scored: DataFrame, statistic: Callable, reps: int, seed: int) -> DataFrame:
    """``rep, value`` of any statistic of a pandas frame of rows: the seam for metrics of one's own. One task a replicate."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rep": [frame["rep"].iloc[0]], "value": [float(statistic(frame))]})

    rows = resample(scored, reps, seed)
    return rows.withColumn("slot", F.col("ord.slot")).withColumn("ord", F.col("ord.ord")).groupBy("rep").applyInPandas(run, "rep int, value double").where("NOT isnan(value)")


def sample_articles(articles: DataFrame, n: int, seed: int) -> DataFrame:
    """The n articles with the lowest draws (a sampling operator: n is its parameter)."""
    return articles.select("article").where("article IS NOT NULL").distinct().withColumn("_d", hash_draw(F.lit(str(seed)), F.col("article"))).orderBy("_d", "article").limit(n).select("article")


def cap_questions(questions: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` questions an article, with its share of unanswerable ones (half-even)."""
    rows = questions.where("article IS NOT NULL").withColumn("is_impossible", F.coalesce("is_impossible", F.lit(False)))
    sizes = rows.groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_impossible").alias("n_imp"))
    quota = F.least(F.col("n_imp"), F.bround(F.lit(float(cap)) * F.col("n_imp") / F.col("n")).cast("bigint"))
    sizes = sizes.withColumn("q_imp", F.when(F.col("n") <= cap, F.col("n_imp")).otherwise(quota)).withColumn("q_pos", F.when(F.col("n") <= cap, F.col("n") - F.col("n_imp")).otherwise(F.least(F.col("n") - F.col("n_imp"), cap - quota)))
    w = Window.partitionBy("article", "is_impossible").orderBy(hash_draw(F.lit(str(seed)), F.col("qid")), "qid")
    ranked = rows.withColumn("_rn", F.row_number().over(w)).join(sizes.select("article", "q_imp", "q_pos"), "article")
    return ranked.where(F.col("_rn") <= F.when(F.col("is_impossible"), F.col("q_imp")).otherwise(F.col("q_pos"))).select("article", "qid", "is_impossible")


def split_articles(articles: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """``article, part``: articles in the order of their draws, cut by half-even rounded counts; the last part takes the rest.

    Raises with fewer articles than parts, or if nothing is left for the last part.
    """
    names = articles.select("article").where("article IS NOT NULL").distinct()
    n = names.count()
    if n < len(PARTS):
        raise ValueError(f"{n} articles for {len(PARTS)} parts")
    counts = [round(fractions[p] * n) for p in PARTS[:-1]]  # Python rounds half to even
    if n - sum(counts) < 1:
        raise ValueError("nothing is left for the last part")
    ordered = running(names.withColumn("_d", hash_draw(F.lit(str(seed)), F.col("article"))).withColumn("_g", F.lit(0)), ["_g"], ["_d", "article"], {})
    part: Column | None = None
    upto = 0
    for p, c in zip(PARTS[:-1], counts):
        upto += c
        part = F.when(F.col("rn") <= upto, p) if part is None else part.when(F.col("rn") <= upto, p)
    return ordered.select("article", part.otherwise(PARTS[-1]).alias("part"))


def split_faults(split: DataFrame, articles: DataFrame) -> DataFrame:
    """``article, parts``: articles in no part or in more than one; empty if the split is sound."""
    n = split.groupBy("article").agg(F.countDistinct("part").alias("parts"))
    every = articles.select("article").where("article IS NOT NULL").distinct()
    return every.join(n, "article", "full").select("article", F.coalesce("parts", F.lit(0)).alias("parts")).where("parts <> 1")


def shared_articles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Articles that two corpora have in common; empty if one can test what the other taught."""
    return a.select("article").where("article IS NOT NULL").distinct().join(b.select("article").distinct(), "article", "left_semi")


def shuffled(rows: DataFrame, column: str, order: list[str], seed: int) -> DataFrame:
    """``column`` dealt anew: the row at place k in ``order`` gets the value of the row at place k by draws."""
    keyed = rows.withColumn("_g", F.lit(0)).withColumn("_d", hash_draw(F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    places = running(keyed, ["_g"], order, {}).drop("n", column, "_d")
    values = running(keyed.select("_g", "_d", *order, F.col(column).alias("_v")), ["_g"], ["_d", *order], {}).select("rn", F.col("_v").alias(column))
    return places.join(values.hint("merge"), "rn").drop("rn", "_g")


def shuffled_columns(rows: DataFrame, columns: list[str], key: str, times: int, seed: int) -> DataFrame:
    """Every row once for each of ``columns`` and each k below ``times``, with that column's value dealt anew: ``signal``, ``k`` and the columns.

    The row at place r in the order of ``key`` gets the value of the row at place r
    by draws of (seed + k, key); the draws of one k are the same for all columns.
    """
    ordered = running(rows.withColumn("_g", F.lit(0)), ["_g"], [key], {}).drop("_g", "n")
    each = ordered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    drawn = rows.select(key, *columns).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_d", hash_draw((F.lit(seed) + F.col("k")).cast("string"), F.col(key)))
    values = running(drawn, ["k"], ["_d", key], {}).select("k", "rn", F.struct(*columns).alias("_v"))
    both = each.join(values.hint("merge"), ["k", "rn"]).drop("rn")
    which = F.explode(F.array(*map(F.lit, columns)))
    long = both.withColumn("signal", which)
    return long.withColumns({c: F.when(F.col("signal") == c, F.col(f"_v.{c}")).otherwise(F.col(c)) for c in columns}).drop("_v")
