"""The queries of the ten problems over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import digest, distinctive, fusion, groupsplit, neardup, overlap, packing, repetition, sentences, tokens
from quillspan.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.records(*[table(spark, folder, t) for t in ("passages", "questions", "article_split")])


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of nearly equal records across training and evaluation parts, with its similarity."""
    return overlap.cross_pairs(_records(spark, folder))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping records and pairs by evaluation part and article."""
    return overlap.report(p1_pairs(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record with a part: its class, copies and links across; copies aren't expanded into pairs."""
    return overlap.memberships(_records(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p1_pairs(spark, folder).where("key_t <> key_e")
    return pairs.select("kind", F.least("key_t", "key_e").alias("key_a"), F.greatest("key_t", "key_e").alias("key_b")).distinct()


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every passage, in order."""
    return sentences.sentences(table(spark, folder, "passages").select("pid", "text").distinct(), "pid", "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_sentences(spark, folder).select("pid", "sent_end").distinct()


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every term of every record."""
    return distinctive.term_scores(table(spark, folder, "passages"), table(spark, folder, "questions")).withColumn("score", F.round("score", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.rare_shared(p3_scores(spark, folder))


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    return groupsplit.article_roots(*[table(spark, folder, t) for t in ("article_split", "passages", "questions")])[0]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groupsplit.same_article(table(spark, folder, "article_split"), _roots(spark, folder))


def p4_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest over article strings."""
    return groupsplit.article_roots(*[table(spark, folder, t) for t in ("article_split", "passages", "questions")])[1]


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    """A part for every passage and question; records of one article share it."""
    shares = [(r["part"], r["share"]) for r in table(spark, folder, "split_share").distinct().orderBy("part").collect()]  # settings: a row a part
    return groupsplit.assign(table(spark, folder, "passages"), table(spark, folder, "questions"), _roots(spark, folder), shares)


def p5_run_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of each stage's time by run, with the certified error of their ranks."""
    return digest.percentiles(table(spark, folder, "predictions_a"), "run_id", [0.5, 0.9, 0.95, 0.99])


def p5_article_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The same by article."""
    return digest.percentiles(table(spark, folder, "predictions_a"), "article", [0.5, 0.9, 0.95, 0.99])


def p5_run_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The quantiles themselves by run: what the certified estimates lead to."""
    out = digest.quantiles(table(spark, folder, "predictions_a"), "run_id", [0.5, 0.9, 0.95, 0.99])
    return out.select(F.col("key").alias("run_id"), "stage", "q", "n", F.round("exact", 9).alias("exact"))


def p5_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles over all runs from the runs' own digests, and whether their ranks are certified to one in a hundred."""
    out = digest.combined(table(spark, folder, "predictions_a"), "run_id", [0.5, 0.9, 0.95, 0.99])
    return out.select("stage", "q", "n", (F.col("rank_error") <= 0.01).alias("within"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return digest.heavy_tails(table(spark, folder, "predictions_a"), "run_id").select(F.col("key").alias("run_id"), "stage")


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of each question in one order."""
    return fusion.fused(fusion.rank_items(table(spark, folder, "retrieved"), "qid", "pid"), "qid", "pid")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first of each question's ranking that is higher than each other passage on two of the three scores, if there is one."""
    return fusion.majority_winners(p6_ranking(spark, folder), "qid", "pid")


def p7_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of nearly equal questions, with its similarity and whether ``is_impossible`` agrees."""
    questions = table(spark, folder, "questions")
    pairs = neardup.NearDuplicates(questions, "qid", "question").pairs()
    flag = questions.where("qid IS NOT NULL").groupBy("qid").agg(F.max("is_impossible").alias("f"))
    a, b = (flag.select(F.col("qid").alias(f"key_{x}"), F.col("f").alias(f"f_{x}")) for x in "ab")
    return pairs.join(a, "key_a").join(b, "key_b").select(F.col("key_a").alias("qid_a"), F.col("key_b").alias("qid_b"), "similarity", F.col("f_a").eqNullSafe(F.col("f_b")).alias("agree"))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group, copies and links of every question with letters or digits."""
    return neardup.NearDuplicates(table(spark, folder, "questions"), "qid", "question").groups().select(F.col("key").alias("qid"), "group", "copies", "links")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, folder, "questions"), "qid", "question").pairs().select(F.col("key_a").alias("qid_a"), F.col("key_b").alias("qid_b"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_documents(table(spark, folder, "documents"), "doc_id", "text", ids="ids")


def _bins(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The kinds of bin: a table of settings with a row a kind."""
    return [(r["bin_name"], r["capacity"]) for r in table(spark, folder, "pack_bins").distinct().orderBy("capacity").collect()]


def p9_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The bin of every piece of every document, for each kind of bin."""
    lengths = packing.token_lengths(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(lengths, "doc_id", "n_tokens", _bins(spark, folder))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the bins are."""
    return packing.fill_report(p9_pack(spark, folder), _bins(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing into bins of the kind 'long' cut."""
    lengths = packing.token_lengths(table(spark, folder, "documents"), "doc_id", "text")
    packed = packing.pack(lengths, "doc_id", "n_tokens", [b for b in _bins(spark, folder) if b[0] == "long"])
    return packed.where("n_pieces > 1 AND piece = 0").select("doc_id")


def p10_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition of every document."""
    return repetition.repetition(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which at least 30 % of the windows are repeated."""
    measured = repetition.repetition(table(spark, folder, "documents"), "doc_id", "text", every=False)
    return repetition.repetitive(measured).select("doc_id").where(F.col("doc_id").isNotNull()).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quillspan.llm.oracle import SQL

    return SQL
