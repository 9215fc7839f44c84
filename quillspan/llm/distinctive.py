"""How distinctive a term is of a record (problem 3).

Method: smoothed language-model divergence. A term's score is its contribution
p(t|d) ln(p(t|d) / p(t|C)) to the relative entropy between the record's
distribution, smoothed with mu pseudo-counts of the collection's, and the
collection's. Terms in fewer records than a least document frequency are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.skew import lookup
from quillspan.session import materialize

#: Pseudo-counts, the least number of passages a term is in, and the span in which a term counts as rare but shared.
MU, MIN_DF = 100.0, 2
FOUND_DF, FOUND_TF = (2, 8), 3
TERM = r"[\p{L}\p{N}_]+"


def record_terms(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """``kind, record_key, term, tf``: terms are runs of letters, digits and underscores of the lower-cased text.

    Rows equal in all columns count once; records without a key, and null, blank
    and mark-only texts have no terms.
    """
    both = passages.select(F.lit("passage").alias("kind"), F.col("pid").cast("string").alias("record_key"), F.col("text").alias("t")).unionByName(
        questions.select(F.lit("question").alias("kind"), F.col("qid").alias("record_key"), F.col("question").alias("t"))
    )
    rows = both.where("record_key IS NOT NULL AND t IS NOT NULL").distinct()
    terms = rows.select("kind", "record_key", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("kind", "record_key", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_scores(passages: DataFrame, questions: DataFrame, mu: float = MU, min_df: int = MIN_DF) -> DataFrame:
    """``kind, record_key, term, tf, df, score`` of every term of every record that at least ``min_df`` passages have.

    ``df`` is the number of different passages with the term; the collection is
    all passages and questions. A score below 0 says that the term is rarer in
    the record than in the collection.
    """
    own = materialize(record_terms(passages, questions), "record-terms")
    stats = own.groupBy("term").agg(F.count_if(F.col("kind") == "passage").alias("df"), F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("holders"))
    total = own.agg(F.sum("tf").alias("t")).first()["t"] or 0
    lengths = own.groupBy("kind", "record_key").agg(F.sum("tf").alias("length"))
    rows = lookup(own, stats.where(F.col("df") >= min_df), "term", "holders")
    rows = rows.join(lengths, ["kind", "record_key"])
    in_all = F.col("cf") / F.lit(float(max(total, 1)))
    in_record = (F.col("tf") + F.lit(mu) * in_all) / (F.col("length") + F.lit(mu))
    return rows.select("kind", "record_key", "term", "tf", "df", (in_record * F.ln(in_record / in_all)).alias("score"))


def rare_shared(scores: DataFrame, df: tuple[int, int] = FOUND_DF, tf: int = FOUND_TF) -> DataFrame:
    """``kind, record_key, term``: scored terms in few passages; of a passage's terms, those it repeats."""
    few = F.col("df").between(*df)
    repeated = (F.col("kind") == "question") | (F.col("tf") >= tf)
    return scores.where(few & repeated).select("kind", "record_key", "term")
