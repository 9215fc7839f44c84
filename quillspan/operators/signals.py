"""The sixteen reliability signals, in three families."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.text import content_words, finite, finite_or_zero, normalize_answer, words

RETRIEVAL = "r_sim_top1 r_sim_margin r_sim_mean_k r_sim_entropy r_n_above_tau r_lex_overlap r_q_len".split()
READER = "d_span_prob d_null_score d_gap d_span_len d_start_end_entropy".split()
AGREEMENT = "a_n_nonnull a_top2_string_sim a_majority_frac a_answer_in_top2".split()
SIGNALS = RETRIEVAL + READER + AGREEMENT
FAMILIES = {"retrieval": RETRIEVAL, "reader": READER, "agreement": AGREEMENT}
TAU, K, WIDE = 0.30, 5, 20


def score_entropy(p: Column) -> Column:
    """Entropy of an array of scores after they are shifted to a least value of 1e-9 and scaled to sum 1."""
    low = F.array_min(p)
    shifted = F.transform(p, lambda x: x - low + 1e-9)
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return -F.aggregate(shifted, F.lit(0.0), lambda a, x: a + (x / total) * F.ln(x / total + 1e-12))


def retrieval_signals(retrieved: DataFrame, questions: DataFrame, passages: DataFrame, k: int = K, wide: int = WIDE, tau: float = TAU) -> DataFrame:
    """``qid`` and the seven retrieval signals. ``retrieved`` has ``qid, rank, pid, hybrid``, one row a rank; scores that aren't finite are left out."""
    ok = F.when(finite(F.col("hybrid")), F.col("hybrid"))
    scores = retrieved.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.when((F.col("rank") <= k) & ok.isNotNull(), F.struct("rank", "pid", ok.alias("h"))))), lambda x: x["h"]).alias("h"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("rank") <= wide) & ok.isNotNull(), F.struct("rank", "pid", ok.alias("h"))))), lambda x: x["h"]).alias("w"),
        F.min(F.when(F.col("rank") == 1, F.col("pid"))).alias("first_pid"),
    )
    scores = scores.withColumn("h", F.when(F.size("h") == 0, F.array(F.lit(0.0))).otherwise(F.col("h")))
    first = passages.select(F.col("pid").alias("first_pid"), F.array_distinct(words(F.col("text"))).alias("lows"))
    rows = questions.join(scores, "qid").join(first, "first_pid", "left").withColumn("cw", content_words(F.col("question")))
    h = F.col("h")
    trimmed = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"[\s\p{Z}]+", " "))
    return rows.select(
        "qid",
        F.get(h, F.lit(0)).alias("r_sim_top1"),
        F.when(F.size(h) > 1, F.get(h, F.lit(0)) - F.get(h, F.lit(1))).otherwise(F.get(h, F.lit(0))).alias("r_sim_margin"),
        (F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / F.size(h)).alias("r_sim_mean_k"),
        score_entropy(F.when(F.size("w") > 1, F.col("w")).otherwise(h)).alias("r_sim_entropy"),
        F.size(F.filter(h, lambda x: x > tau)).cast("double").alias("r_n_above_tau"),
        F.when(F.size("cw") > 0, F.size(F.array_intersect("cw", F.coalesce("lows", F.array().cast("array<string>")))) / F.greatest(F.size("cw"), F.lit(1))).otherwise(0.0).alias("r_lex_overlap"),
        F.when(trimmed == "", 0.0).otherwise(F.size(F.split(trimmed, " ")).cast("double")).alias("r_q_len"),
    )


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; 0 if either is blank."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def softmax(scored: DataFrame, by: list[str], value: str, sharpness: float = 10.0) -> DataFrame:
    """Add ``prob`` and ``entropy``: the softmax of ``sharpness`` times the value within each group, and its entropy."""
    w = Window.partitionBy(*by)
    e = F.exp(sharpness * F.col(value) - F.max(sharpness * F.col(value)).over(w))
    rows = scored.withColumn("_e", e).withColumn("prob", F.col("_e") / (F.sum("_e").over(w) + 1e-12)).drop("_e")
    return rows.withColumn("entropy", -F.sum(F.col("prob") * F.ln(F.col("prob") + 1e-12)).over(w))


def agreement_signals(read: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid`` and the four agreement signals from ``qid, rank, pid, answer, raw``: one row a passage read, ranks from 1."""
    rows = read.withColumn("norm", normalize_answer(F.col("answer")))
    best = rows.groupBy("qid").agg(F.max_by("norm", F.struct("raw", -F.col("rank"))).alias("top"), F.count_if(F.col("norm") != "").cast("double").alias("a_n_nonnull"))
    w = Window.partitionBy("qid").orderBy("rank")
    placed = rows.withColumn("place", F.row_number().over(w))
    pair = placed.groupBy("qid").agg(F.max(F.when(F.col("place") == 1, F.col("norm"))).alias("x"), F.max(F.when(F.col("place") == 2, F.col("norm"))).alias("y"), F.max(F.when(F.col("rank") == 2, F.col("pid"))).alias("second"))
    votes = rows.where("norm <> ''").groupBy("qid", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("qid").agg((F.max("n") / F.sum("n")).alias("a_majority_frac"))
    second = passages.select(F.col("pid").alias("second"), F.lower("text").alias("second_text"))
    out = best.join(pair, "qid").join(votes, "qid", "left").join(second, "second", "left")
    return out.select(
        "qid", "a_n_nonnull",
        matching_ratio(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit(""))).alias("a_top2_string_sim"),
        F.coalesce("a_majority_frac", F.lit(0.0)).alias("a_majority_frac"),
        ((F.col("top") != "") & F.coalesce(F.col("second_text").contains(F.col("top")), F.lit(False))).cast("double").alias("a_answer_in_top2"),
    )


def reader_signals(best: DataFrame) -> DataFrame:
    """``qid`` and the five reader signals from the chosen span: ``qid, prob, null_score, len, entropy``."""
    return best.select(
        "qid", F.col("prob").alias("d_span_prob"), F.col("null_score").alias("d_null_score"), (F.col("prob") - F.col("null_score")).alias("d_gap"),
        F.col("len").cast("double").alias("d_span_len"), F.col("entropy").alias("d_start_end_entropy"),
    )


def assemble(retrieval: DataFrame, reader: DataFrame, agreement: DataFrame) -> DataFrame:
    """One row a question with the 16 signals in their order; questions that weren't read have the reader's defaults."""
    rows = retrieval.join(reader, "qid", "left").join(agreement, "qid", "left")
    defaults = dict.fromkeys(READER + AGREEMENT, 0.0) | {"d_null_score": 1.0, "d_gap": -1.0}
    out = rows.select("qid", *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in SIGNALS])
    if out.columns[1:] != SIGNALS:
        raise AssertionError("the signals differ from the sixteen")
    return out


def matrix(rows: DataFrame, struct: str = "features", columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The signals as columns, null, NaN and infinite values as 0."""
    return rows.select(*(keep or []), *[finite_or_zero(F.col(f"{struct}.{c}")).alias(c) for c in (columns or SIGNALS)])
