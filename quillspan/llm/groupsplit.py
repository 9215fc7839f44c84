"""Splits that keep related records together (problem 4).

Method: Borůvka-style contraction builds a persisted spanning forest over the
ways an article is written; its roots, banded by size, are dealt systematically.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.forest import spanning_forest
from quillspan.llm.setjoin import spread
from quillspan.session import materialize

#: Marks of one shape, as they count in a title (fixed values).
_QUOTES = dict.fromkeys(map(ord, "’‘ʼ‛′`´＇‚"), "'") | dict.fromkeys(map(ord, "“”„‟«»″＂"), '"')
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
#: Components with more than one in HEAVY of the records are dealt one by one.
HEAVY = 1000


def title_key(title: str) -> str:
    """What stays of a title when the way it is written is taken away.

    Percent and HTML escapes are undone, then NFKC, case folding, one shape for
    quotes; blanks, underscores, dashes, control and invisible characters go.
    Letters, digits, combining marks, brackets and other marks stay.
    """
    for _ in range(3):
        before = title
        if _PERCENT.search(title):
            try:
                title = unquote(title, errors="strict")
            except UnicodeDecodeError:
                pass
        title = html.unescape(title)
        if title == before:
            break
    # marks first: NFKC would turn a free-standing accent into a blank and an accent
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", title.translate(_QUOTES)).casefold()).translate(_QUOTES)
    return "".join(c for c in folded if c != "_" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc", "Cf", "Pd") and not "\ufe00" <= c <= "\ufe0f")


@F.pandas_udf(T.StringType())
def title_keys(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in titles:
        yield batch.map(title_key, na_action="ignore")


def article_edges(articles: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """``a, b``: articles that are one.

    Titles with one key are joined to the least of them. A question's article is
    joined to that of its gold passage. Nulls and passages that don't exist give no edge.
    """
    keyed = articles.where("article IS NOT NULL").select("article").distinct().withColumn("k", title_keys("article")).where("k <> ''")
    least = keyed.groupBy("k").agg(F.min("article").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    written = keyed.join(spread(least), "k").where("article <> a").select("a", F.col("article").alias("b"))
    asked = questions.where("article IS NOT NULL AND gold_pid IS NOT NULL").select(F.col("article").alias("a"), F.col("gold_pid").alias("pid")).distinct()
    stands = passages.where("article IS NOT NULL AND pid IS NOT NULL").select("pid", F.col("article").alias("b")).distinct()
    linked = asked.join(spread(stands), "pid").where("a <> b").select("a", "b").distinct()
    return written.unionByName(linked)


def article_roots(articles: DataFrame, passages: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(article, root)`` of every article in any of the tables, and the spanning forest ``a, b``."""
    every = articles.select("article").unionAll(passages.select("article")).unionAll(questions.select("article")).where("article IS NOT NULL").distinct()
    labels, forest = spanning_forest(article_edges(every, passages, questions))
    roots = every.join(spread(labels.withColumnRenamed("v", "article")), "article", "left").select("article", F.coalesce("root", "article").alias("root"))
    return materialize(roots, "article-roots"), forest


def same_article(articles: DataFrame, roots: DataFrame) -> DataFrame:
    """``article_a, article_b``: pairs of different strings of ``articles`` with one root.

    The pairs are the result, so their number is what it is; what is shuffled are
    the strings. Those of one root are sorted, and each meets the ones after it.
    """
    own = articles.select("article").distinct().join(spread(roots), "article")
    many = own.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("root")
    own = own.join(spread(many), "root", "left_semi")
    a, b = (own.select("root", F.col("article").alias(f"article_{x}")) for x in "ab")
    return spread(a).join(b, "root").where("article_a < article_b").select("article_a", "article_b")


def deal(units: DataFrame, shares: list[tuple[str, float]], rows_a_part: int = 1_000_000) -> DataFrame:
    """Give each unit (``unit``, ``size``) a part so that the parts' sizes follow ``shares``.

    Units with more than one in HEAVY of all records, fewer than HEAVY in number,
    go one by one to the part that lacks most. The others are banded by the power
    of two of their size and, in each band, dealt systematically: in an order by
    hash, a unit gets the part whose span of the band's cumulated size holds the
    unit's middle. What the heavy units took is taken off the spans. A band of very
    many units is dealt in several stretches of its own.
    """
    parts = [(p, s) for p, s in shares if s > 0]
    if not parts:
        raise ValueError("no part has a share")
    whole = units.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, scale = whole["t"], sum(s for _, s in parts)
    lack = {p: total * s / scale for p, s in parts}
    heavy = [(r["unit"], r["size"]) for r in units.where(F.col("size") * HEAVY > total).select("unit", "size").collect()]
    dealt = {}
    for unit, size in sorted(heavy, key=lambda u: (-u[1], u[0])):
        dealt[unit] = max(lack, key=lambda p: (lack[p], p))
        lack[dealt[unit]] -= size
    room = {p: max(0.0, x) for p, x in lack.items()}
    left = sum(room.values()) or 1.0
    spark = units.sparkSession
    schema = T.StructType([units.schema["unit"], T.StructField("part", T.StringType())])
    one_by_one = spark.createDataFrame(list(dealt.items()), schema)
    stretches = max(1, -(-whole["n"] // rows_a_part))
    light = units.where(F.col("size") * HEAVY <= total).select("unit", "size", F.floor(F.log2("size")).alias("band"), F.pmod(F.xxhash64("unit"), F.lit(stretches)).alias("stretch"))
    in_band = Window.partitionBy("band", "stretch")
    order = in_band.orderBy(F.xxhash64(F.lit("deal"), "unit"), "unit").rowsBetween(Window.unboundedPreceding, 0)
    # each stretch starts at a place of its own, or small ones would all favour the middle part
    start = F.pmod(F.xxhash64(F.lit("start"), "band", "stretch"), F.lit(1 << 20)) / F.lit(1 << 20)
    placed = light.withColumn("at", (F.sum("size").over(order) - F.col("size") / 2) / F.sum("size").over(in_band) + start)
    at, upto, column = F.col("at") - F.floor("at"), 0.0, None
    for p, _ in parts[:-1]:
        upto += room[p] / left
        column = F.when(at < upto, p) if column is None else column.when(at < upto, p)
    part = F.lit(parts[-1][0]) if column is None else column.otherwise(parts[-1][0])
    return placed.select("unit", part.alias("part")).unionByName(one_by_one)


def assign(passages: DataFrame, questions: DataFrame, roots: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """``kind, record_key, article, unit, part``: every different passage and question with its part.

    The unit is the article's root. A question without an article goes with its
    gold passage, a passage without one with the least root of the questions
    about it; what remains is a unit by itself. Rows equal in all columns count once.
    """
    p = passages.select("pid", "article").distinct().join(roots, "article", "left")
    q = questions.select("qid", "article", "gold_pid").distinct().join(roots, "article", "left")
    gold = p.where("root IS NOT NULL").groupBy("pid").agg(F.min("root").alias("gold_root"))
    q = q.join(gold, F.col("gold_pid") == F.col("pid"), "left").drop("pid")
    q = q.withColumn("unit", F.coalesce("root", "gold_root"))
    asked = q.where("unit IS NOT NULL AND gold_pid IS NOT NULL").groupBy(F.col("gold_pid").alias("pid")).agg(F.min("unit").alias("asked_root"))
    p = p.join(asked, "pid", "left").withColumn("unit", F.coalesce("root", "asked_root"))
    alone = lambda kind, key: F.concat(F.lit(f"\u0000{kind} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = p.select(F.lit("passage").alias("kind"), F.col("pid").cast("string").alias("record_key"), "article", F.coalesce("unit", alone("p", "pid")).alias("unit"))
    rows = rows.unionByName(q.select(F.lit("question").alias("kind"), F.col("qid").alias("record_key"), "article", F.coalesce("unit", alone("q", "qid")).alias("unit")))
    rows = materialize(rows, "split-records")
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(deal(sizes, shares), "unit").select("kind", "record_key", "article", "unit", "part")
