"""Tokens, content words, answer normalisation and question types as column expressions.

Words are runs of letters, numbers and underscores of any script; Spark's own
``\\w`` knows ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
#: A word, or one mark.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
#: The words that carry no content, the marks at which no span starts or ends, sentence ends.
STOPWORDS = (
    "a an the of in on at to for with by from as is are was were be been being "
    "and or but if then than that this these those it its he she they them his her their we you i"
).split()
EDGE_MARKS = list(".,;:!?()[]\"'`-")
SENTENCE_ENDS = [".", "!", "?"]
#: ASCII punctuation, which answers lose, and the articles, which they lose too.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ["a", "an", "the"]
#: Question words in the order in which they are looked for.
QUESTION_WORDS = ["who", "when", "where", "which", "why", "what", "how"]


def words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def long_words(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_WORD), F.lit(0))


def reader_tokens(text: Column) -> Column:
    """Words and single marks, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


def content_words(question: Column) -> Column:
    """Different words of the question that are no stopwords and longer than one character."""
    return F.array_distinct(F.filter(words(question), lambda w: (F.length(w) > 1) & ~is_stopword(w)))


def normalize_answer(answer: Column) -> Column:
    """Lower case, without ASCII punctuation, without articles as whole words, single blanks."""
    plain = F.translate(F.lower(F.coalesce(answer, F.lit(""))), PUNCTUATION, "")
    # after the deletion of marks, words are what blanks part; an article next to a mark outside ASCII is a word too
    bare = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def answer_tokens(answer: Column) -> Column:
    """The words of the normalised answer, repeated ones too."""
    return F.filter(F.split(normalize_answer(answer), " "), lambda w: w != "")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token arrays as multisets; 1 if both are empty, 0 if one is."""
    common = F.aggregate(
        F.array_distinct(gold),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(pred, lambda x: x == w)), F.size(F.filter(gold, lambda x: x == w))),
    )
    empty = (F.size(pred) == 0) | (F.size(gold) == 0)
    both = F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0).otherwise(0.0)
    p, r = common / F.greatest(F.size(pred), F.lit(1)), common / F.greatest(F.size(gold), F.lit(1))
    return F.when(empty, both).when(common == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def best_f1(pred: Column, golds: Column) -> Column:
    """The best F1 against any of the gold answers; 0 without gold answers."""
    tokens = answer_tokens(pred)
    return F.aggregate(F.coalesce(golds, F.array().cast("array<string>")), F.lit(0.0), lambda best, g: F.greatest(best, F.coalesce(token_f1(tokens, answer_tokens(g)), F.lit(0.0))))


def exact_match(pred: Column, golds: Column) -> Column:
    """1 if any gold answer equals the prediction after normalisation, else 0."""
    mine = normalize_answer(pred)
    return F.when(F.exists(F.coalesce(golds, F.array().cast("array<string>")), lambda g: normalize_answer(g) == mine), 1.0).otherwise(0.0)


def is_blank(answer: Column) -> Column:
    return answer.isNull() | (F.regexp_replace(answer, r"[\s\p{Z}]+", "") == "")


def is_correct(pred: Column, golds: Column, impossible: Column, threshold: float = 0.5) -> Column:
    """An unanswerable question wants a blank; an answerable one an answer with an F1 of at least the threshold."""
    return F.when(F.coalesce(impossible, F.lit(False)), is_blank(pred)).otherwise(~is_blank(pred) & (best_f1(pred, golds) >= threshold))


def question_type(question: Column) -> Column:
    """The first rule that holds: how many / how much, then the question words by prefix or as a word among the first 40 characters."""
    q = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    out = F.when(q.startswith("how many") | q.startswith("how much") | q.contains(" how many "), "how_many")
    for w in QUESTION_WORDS:
        out = out.when(q.startswith(w) | F.substring(q, 1, 40).contains(f" {w} "), w)
    return out.otherwise("other")


def hash_draw(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that is a pure function of the parts, equal on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def finite(value: Column) -> Column:
    """Is the value a finite number (not null, NaN or infinite)?"""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def finite_or_zero(value: Column) -> Column:
    return F.when(finite(value), value).otherwise(F.lit(0.0))
