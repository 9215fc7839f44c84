"""Queries over texts, retrieval and spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import learned, retrieval, signals, spans
from quillspan.session import materialize
from quillspan.sources.tables import table

W = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
EDGE = ", ".join("'" + m.replace("'", "''") + "'" for m in T.EDGE_MARKS)
WORDS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '{W}')"
CONTENT = lambda c: f"list_distinct(list_filter({WORDS(c)}, lambda w: length(w) > 1 AND w NOT IN ({STOP})))"
QTYPE = lambda c: (
    f"CASE WHEN starts_with(trim(lower(coalesce({c}, ''))), 'how many') OR starts_with(trim(lower(coalesce({c}, ''))), 'how much') OR contains(trim(lower(coalesce({c}, ''))), ' how many ') THEN 'how_many' "
    + " ".join(f"WHEN starts_with(trim(lower(coalesce({c}, ''))), '{w}') OR contains(substr(trim(lower(coalesce({c}, ''))), 1, 40), ' {w} ') THEN '{w}'" for w in T.QUESTION_WORDS)
    + " ELSE 'other' END"
)
#: Common table expressions that the SQL texts share.
CORPUS = f"""c AS (SELECT DISTINCT pid, article, text FROM passages WHERE pid IS NOT NULL AND text IS NOT NULL AND len({WORDS('text')}) > 0)"""
ASKABLE = """q AS (SELECT DISTINCT qid, article, gold_pid, question FROM questions WHERE qid IS NOT NULL AND question IS NOT NULL)"""
TERMS = f"""tc AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({WORDS('text')}) AS term FROM c) GROUP BY 1, 2)"""
LONG = W.replace("]+", "]{2,}")
BM25 = f"""{CORPUS}, {ASKABLE}, {TERMS},
dl AS (SELECT pid, sum(tf) AS dl FROM tc GROUP BY 1), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM tot) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tc GROUP BY 1),
bt AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
bp AS (SELECT tc.pid, c.article, tc.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM tot))) AS w FROM tc JOIN bt USING (term) JOIN dl USING (pid) JOIN c USING (pid)),
qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({WORDS('question')}) AS term FROM q) GROUP BY 1, 2),
lex AS (SELECT q.qid, bp.pid, round(sum(qt.tf * bp.w), 6) AS score FROM qt JOIN q USING (qid) JOIN bp USING (term)
  WHERE q.article IS NULL OR bp.article IS NULL OR q.article <> bp.article OR bp.pid IS NOT DISTINCT FROM q.gold_pid GROUP BY 1, 2)"""
TFIDF = f"""lc AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest(regexp_extract_all(lower(text), '{LONG}')) AS term FROM c) GROUP BY 1, 2),
lt AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM lc GROUP BY 1 HAVING count(*) >= 2),
lw AS (SELECT pid, term, (1 + ln(tf)) * idf AS w FROM lc JOIN lt USING (term)),
lv AS (SELECT pid, term, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS w FROM lw)"""
COSINE = f"""{TFIDF},
ql AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '{LONG}')) AS term FROM q) GROUP BY 1, 2),
qw AS (SELECT qid, term, (1 + ln(tf)) * idf AS w FROM ql JOIN lt USING (term)),
qv AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qw),
den AS (SELECT q.qid, lv.pid, round(sum(qv.w * lv.w), 6) AS score FROM qv JOIN q USING (qid) JOIN lv USING (term) JOIN c USING (pid)
  WHERE q.article IS NULL OR c.article IS NULL OR q.article <> c.article OR lv.pid IS NOT DISTINCT FROM q.gold_pid GROUP BY 1, 2)"""
TOKENS = f"""{CORPUS}, t0 AS (SELECT pid, text, regexp_extract_all(text, '{TOKEN}') AS a, regexp_split_to_array(text, '{TOKEN}') AS g FROM c),
t1 AS (SELECT pid, unnest(a) AS token, unnest(g[1:len(a)]) AS gap, unnest(range(len(a))) AS pos, len(a) AS n FROM t0),
tok AS (SELECT pid, CAST(sum(length(token) + length(gap)) OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(token) AS INT) AS c0,
  CAST(sum(length(token) + length(gap)) OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS c1, pos, token, lower(token) AS low, CAST(regexp_matches(token, '^\\p{{Lu}}') AS INT) AS is_cap, CAST(regexp_matches(token, '^[\\p{{Nd}},.]+$') AS INT) AS is_num,
  CAST(lower(token) IN ({STOP}) AS INT) AS is_stop, (lower(token) IN ({STOP}) OR token IN ({EDGE})) AS is_edge, n,
  CAST(coalesce(sum(CASE WHEN token IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS sent_id FROM t1)"""
ASKED = f"""{ASKABLE}, ask AS (SELECT qid, gold_pid AS pid, {CONTENT('question')} AS words, {QTYPE('question')} AS qtype FROM q WHERE gold_pid IS NOT NULL)"""
OVERLAP = """sents AS (SELECT pid, sent_id, list_distinct(list(low)) AS lows FROM tok GROUP BY 1, 2),
ov AS (SELECT qid, pid, sent_id, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: list_contains(lows, w))) / len(words) ELSE 0 END AS overlap FROM ask JOIN sents USING (pid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, pid ORDER BY overlap DESC, sent_id) - 1 AS sent_rank FROM ov)"""


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.corpus(table(spark, folder, "passages"))


def _askable(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.askable(table(spark, folder, "questions"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Articles, passages, questions and the share of unanswerable questions."""
    p = table(spark, folder, "passages").select("pid", "article").distinct().agg(F.countDistinct("article").alias("articles"), F.countDistinct("pid").alias("passages"))
    q = table(spark, folder, "questions").groupBy("qid").agg(F.max("is_impossible").alias("f")).agg(F.count(F.lit(1)).alias("questions"), F.count_if("f").alias("unanswerable"))
    return p.crossJoin(q).withColumn("unanswerable_frac", F.round(F.col("unanswerable") / F.greatest(F.col("questions"), F.lit(1)), 4))  # one row each


def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.idf(_corpus(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_terms(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    return retrieval.bm25_terms(retrieval.term_counts(c, "pid", "text"), c.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    counts = retrieval.term_counts(c, "pid", "text", long=True)
    return retrieval.tfidf_vectors(counts, retrieval.tfidf_terms(counts, c.count()), "pid").select("pid", "term", F.round("weight", 6).alias("weight"))


def retrieve_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The five best passages of each question by BM25, without siblings of its article."""
    return retrieval.bm25(_corpus(spark, folder), _askable(spark, folder), k=5).select("qid", "rank", "pid", "score")


def retrieve_unmasked(spark: SparkSession, folder: str) -> DataFrame:
    """The same over all passages, as for a user's question."""
    return retrieval.bm25(_corpus(spark, folder), _askable(spark, folder), masked=False, k=5).select("qid", "rank", "pid", "score")


def retrieve_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.tfidf_cosine(_corpus(spark, folder), _askable(spark, folder), k=5).select("qid", "rank", "pid", "score")


def retrieve_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best passages by the mixture of both scores."""
    return retrieval.hybrid(_corpus(spark, folder), _askable(spark, folder), 20)


def fused_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture for the scores of the table retrieved: its dense and lexical score, each scaled over a question's passages, ranked anew."""
    best = lambda c: F.max(T.finite_or_zero(F.col(c))).alias(c)
    rows = table(spark, folder, "retrieved").where("qid IS NOT NULL AND pid IS NOT NULL").groupBy("qid", "pid").agg(best("dense"), best("bm25"))
    return retrieval.fuse(rows, 20)


def retrieve_latent(spark: SparkSession, folder: str) -> DataFrame:
    """The five best passages by cosine in the latent space."""
    held, asked, _ = retrieval.latent_vectors(_corpus(spark, folder), _askable(spark, folder))
    return retrieval.nearest(held, asked, 5)


def gold_in_top(spark: SparkSession, folder: str) -> DataFrame:
    """By part, the share of questions whose gold passage is among the five best by BM25; one without any hit counts as not found."""
    best = retrieve_bm25(spark, folder).groupBy("qid").agg(F.collect_set("pid").alias("pids"))
    q = _askable(spark, folder).join(best, "qid", "left").join(table(spark, folder, "article_split"), "article")
    return q.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.array_contains("pids", F.col("gold_pid")), F.lit(False)).cast("int")), 6).alias("gold_in_k"))


def question_types(spark: SparkSession, folder: str) -> DataFrame:
    q = _askable(spark, folder)
    return q.select("qid", T.question_type(F.col("question")).alias("qtype"), F.array_join(F.array_sort(T.content_words(F.col("question"))), " ").alias("content")).distinct()


def span_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spans.tokens(_corpus(spark, folder))


def span_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spans.candidates(spans.tokens(_corpus(spark, folder))).select("pid", "start", "len", "c0", "c1")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return spans.question_words(_askable(spark, folder).where("gold_pid IS NOT NULL"))


def sentence_overlap(spark: SparkSession, folder: str) -> DataFrame:
    out = spans.sentence_overlap(_asked(spark, folder), spans.tokens(_corpus(spark, folder)))
    return out.select("qid", "pid", "sent_id", F.round("overlap", 6).alias("overlap"), "sent_rank")


def span_features(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty features of every candidate span of each question's gold passage, over the three best sentences."""
    c = _corpus(spark, folder)
    toks = materialize(spans.tokens(c), "tokens")
    out = spans.features(_asked(spark, folder), toks, retrieval.idf(c), spans.candidates(toks))
    return out.select("qid", "pid", "start", "len", *[F.round(f, 5).alias(f) for f in spans.FEATURES])


def gold_spans(spark: SparkSession, folder: str) -> DataFrame:
    """By question, the candidates of its gold passage that are one of its answers."""
    c = _corpus(spark, folder)
    texts = spans.span_texts(spans.candidates(spans.tokens(c)), c).withColumn("norm", T.normalize_answer(F.col("answer")))
    q = table(spark, folder, "questions").where("qid IS NOT NULL AND gold_pid IS NOT NULL AND answers IS NOT NULL").select("qid", F.col("gold_pid").alias("pid"), F.explode(F.col("answers")).alias("gold")).select("qid", "pid", T.normalize_answer(F.col("gold")).alias("norm")).where("norm <> ''").distinct()
    asked = q.groupBy("pid").agg(F.collect_list(F.struct("qid", "norm")).alias("_q"))
    hit = F.explode(F.filter("_q", lambda x: x["norm"] == F.col("norm")))
    return texts.join(asked.hint("merge"), "pid").select("start", "len", hit.alias("_q")).select("_q.qid", "start", "len").groupBy("qid").agg(F.countDistinct("start", "len").alias("spans"), F.min("start").alias("first_start"))


def training_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates that a span scorer would be fitted on, with 400 negatives for each positive, and their labels."""
    c = _corpus(spark, folder)
    toks = materialize(spans.tokens(c), "tokens")
    featured = spans.features(_asked(spark, folder), toks, retrieval.idf(c), spans.candidates(toks))
    gold = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: T.normalize_answer(a)), lambda a: a != "")
    golds = table(spark, folder, "questions").where("qid IS NOT NULL").groupBy("qid").agg(F.max(F.coalesce("is_impossible", F.lit(False))).alias("is_impossible"), F.first(gold).alias("golds"))
    return learned.training_spans(spans.span_texts(featured, c), golds, features=[]).select("qid", "pid", "start", "len", "label", F.round("weight", 6).alias("weight"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The table retrieved with one row a question and rank."""
    return table(spark, folder, "retrieved").groupBy("qid", "rank").agg(F.min(F.struct("pid", "dense", "bm25", "hybrid")).alias("r")).select("qid", "rank", "r.*")


def retrieval_signals(spark: SparkSession, folder: str) -> DataFrame:
    q = _askable(spark, folder).select("qid", "question").groupBy("qid").agg(F.min("question").alias("question"))
    texts = _corpus(spark, folder).groupBy("pid").agg(F.min("text").alias("text"))
    out = signals.retrieval_signals(_ranked(spark, folder), q, texts)
    return out.select("qid", *[F.round(c, 9 if c.startswith("r_sim") and c != "r_sim_entropy" else 5).alias(c) for c in signals.RETRIEVAL])


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The retrieved passages of each question as evidence: article, score and the first 400 characters shown."""
    texts = _corpus(spark, folder).groupBy("pid").agg(F.min(F.struct("article", "text")).alias("t"))
    rows = _ranked(spark, folder).where("rank <= 5").join(texts, "pid", "left")
    return rows.select("qid", "rank", "pid", F.col("t.article").alias("article"), F.round("hybrid", 6).alias("score"), F.substring("t.text", 1, 400).alias("shown"))


def mask_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved siblings of the question's own article other than its gold passage, by source: our own search (none) and the table retrieved."""
    own = retrieve_bm25(spark, folder).select(F.lit("search").alias("source"), "qid", "pid")
    given = table(spark, folder, "retrieved").where("qid IS NOT NULL AND pid IS NOT NULL").select(F.lit("table").alias("source"), "qid", "pid").distinct()
    found = own.unionByName(given).join(_corpus(spark, folder).select("pid", F.col("article").alias("p_article")), "pid").join(_askable(spark, folder), "qid")
    return found.where("p_article = article AND NOT (pid <=> gold_pid)").select("source", "qid", "pid").distinct()


_PUNCT = T.PUNCTUATION.replace("'", "''")
NORM = lambda c: (
    f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(translate(lower(coalesce({c}, '')), '{_PUNCT}', ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda t: CASE WHEN t IN ('a', 'an', 'the') THEN ' ' ELSE t END), ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
)
CANDIDATES = """cand AS (SELECT a.pid, a.pos AS start, b.pos - a.pos + 1 AS len, a.c0, b.c1 FROM tok a JOIN tok b ON a.pid = b.pid AND b.pos BETWEEN a.pos AND a.pos + 7 WHERE NOT a.is_edge AND NOT b.is_edge)"""

SQL = {
    "corpus_stats": """SELECT p.*, q.*, round(unanswerable / greatest(questions, 1), 4) AS unanswerable_frac FROM (SELECT count(DISTINCT article) AS articles, count(DISTINCT pid) AS passages FROM passages) p,
      (SELECT count(*) AS questions, count(*) FILTER (WHERE f) AS unanswerable FROM (SELECT qid, max(is_impossible) AS f FROM questions GROUP BY 1)) q""",
    "term_idf": f"WITH {CORPUS}, {TERMS} SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM c) / (1 + count(*))) + 1, 6) AS idf FROM tc GROUP BY 1",
    "bm25_terms": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM bt",
    "tfidf_vectors": f"WITH {CORPUS}, {TFIDF} SELECT pid, term, round(w, 6) AS weight FROM lv",
    "retrieve_bm25": f"WITH {BM25} SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, pid, score FROM lex) WHERE rank <= 5",
    "retrieve_unmasked": f"WITH {BM25.split('WHERE q.article IS NULL OR bp')[0]} GROUP BY 1, 2) SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, pid, score FROM lex) WHERE rank <= 5",
    "retrieve_tfidf": f"WITH {CORPUS}, {ASKABLE}, {COSINE} SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, pid, score FROM den) WHERE rank <= 5",
    "fused_scores": """WITH b AS (SELECT qid, pid, max(CASE WHEN isfinite(dense) THEN dense ELSE 0 END) AS d, max(CASE WHEN isfinite(bm25) THEN bm25 ELSE 0 END) AS l FROM retrieved WHERE qid IS NOT NULL AND pid IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT qid, pid, d AS dense, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-9) AS x, (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w + 1e-9) AS y FROM b WINDOW w AS (PARTITION BY qid)),
      f AS (SELECT qid, pid, dense, round(y, 6) AS bm25, round(0.5 * x + 0.5 * y, 6) AS hybrid FROM m)
      SELECT qid, rank, pid, dense, bm25, hybrid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid DESC, pid) AS rank FROM f) WHERE rank <= 20""",
    "gold_in_top": f"""WITH {BM25}, top AS (SELECT qid, list(pid) AS pids FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM lex) WHERE rank <= 5 GROUP BY 1)
      SELECT part, count(*) AS n, round(avg(CASE WHEN coalesce(list_contains(pids, gold_pid), false) THEN 1 ELSE 0 END), 6) AS gold_in_k FROM q LEFT JOIN top USING (qid) JOIN article_split USING (article) GROUP BY 1""",
    "question_types": f"WITH {ASKABLE} SELECT DISTINCT qid, {QTYPE('question')} AS qtype, array_to_string(list_sort({CONTENT('question')}), ' ') AS content FROM q",
    "span_tokens": f"WITH {TOKENS} SELECT pid, pos, token, low, is_cap, is_num, is_stop, is_edge, sent_id, n, c0, c1 FROM tok",
    "span_candidates": f"WITH {TOKENS} SELECT a.pid, a.pos AS start, b.pos - a.pos + 1 AS len, a.c0, b.c1 FROM tok a JOIN tok b ON a.pid = b.pid AND b.pos BETWEEN a.pos AND a.pos + 7 WHERE NOT a.is_edge AND NOT b.is_edge",
    "sentence_overlap": f"WITH {TOKENS}, {ASKED}, {OVERLAP} SELECT qid, pid, sent_id, round(overlap, 6) AS overlap, sent_rank FROM rk",
    "span_features": f"""WITH {TOKENS}, {ASKED}, {OVERLAP}, {TERMS}, idf AS (SELECT term, ln((SELECT count(*) FROM c) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY 1),
      x AS (SELECT qid, tok.*, words, qtype, coalesce(idf, 8.0) AS idf, CAST(list_contains(words, low) AS INT) AS in_q, overlap, sent_rank FROM ask JOIN tok USING (pid) LEFT JOIN idf ON idf.term = low JOIN rk USING (qid, pid, sent_id)),
      y AS (SELECT *, coalesce(sum(is_cap) OVER b, 0) AS c_cap, coalesce(sum(is_num) OVER b, 0) AS c_num, coalesce(sum(is_stop) OVER b, 0) AS c_stop, coalesce(sum(in_q) OVER b, 0) AS c_inq, coalesce(sum(idf) OVER b, 0) AS c_idf,
        coalesce(least(pos - max(CASE WHEN in_q = 1 THEN pos END) OVER (PARTITION BY qid, pid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(CASE WHEN in_q = 1 THEN pos END) OVER (PARTITION BY qid, pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos), n) AS dist
        FROM x WINDOW b AS (PARTITION BY qid, pid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      h AS (SELECT qid, pid, list({{'cap': c_cap, 'num': c_num, 'stop': c_stop, 'inq': c_inq, 'idf': c_idf, 'edge': is_edge, 'sent': sent_id, 'c1': c1, 'ecap': c_cap + is_cap, 'enum': c_num + is_num, 'estop': c_stop + is_stop, 'einq': c_inq + in_q, 'eidf': c_idf + idf}} ORDER BY pos) AS t,
        min(CASE WHEN NOT is_edge THEN sent_rank END) AS best FROM y GROUP BY 1, 2),
      z AS (SELECT y.*, t, unnest(range(1, least(8, n - pos) + 1)) AS len FROM y JOIN h USING (qid, pid) WHERE NOT is_edge AND (sent_rank < 3 OR best >= 3)),
      w AS (SELECT *, t[pos + len] AS e FROM z),
      k AS (SELECT *, e.ecap - c_cap AS t_cap, e.enum - c_num AS t_num, e.estop - c_stop AS t_stop, e.einq - c_inq AS t_inq, e.eidf - c_idf AS t_idf, e.sent AS e_sent, e.einq AS e_end, t[greatest(pos - 4, 0) + 1].inq AS l_c, pos - greatest(pos - 4, 0) AS l_n,
        t[least(pos + len + 4, n)].einq AS r_c, least(pos + len + 4, n) - pos - len AS r_n FROM w WHERE NOT e.edge)
      SELECT qid, pid, pos AS start, len, {", ".join(f"round({e}, 5) AS {n}" for n, e in {
        "f_len": "CAST(len AS DOUBLE)", "f_cap": "t_cap / len", "f_num": "t_num / len", "f_stop": "t_stop / len", "f_inq": "t_inq / len", "f_idf": "t_idf / len", "f_dist": "CAST(dist AS DOUBLE)", "f_overlap": "overlap", "f_rel": "pos / n",
        "f_same": "CAST(sent_id = e_sent AS DOUBLE)", "f_start_cap": "CAST(is_cap AS DOUBLE)", "f_cap_wanted": "t_cap / len * CAST(qtype IN ('who', 'where', 'which') AS DOUBLE)", "f_num_wanted": "t_num / len * CAST(qtype IN ('when', 'how_many') AS DOUBLE)",
        "f_score": "CAST(1 AS DOUBLE)", "f_q_words": "CAST(len(words) AS DOUBLE)", "f_overlap_new": "overlap * (1 - t_inq / len)", "f_left": "(c_inq - l_c) / greatest(l_n, 1)", "f_right": "(r_c - e_end) / greatest(r_n, 1)", "f_all_cap": "CAST(t_cap = len AS DOUBLE)", "f_sent_rank": "CAST(sent_rank AS DOUBLE)"}.items())} FROM k""",
    "retrieval_signals": f"""WITH {CORPUS}, {ASKABLE}, q1 AS (SELECT qid, min(question) AS question FROM q GROUP BY 1), tx AS (SELECT pid, min(text) AS text FROM c GROUP BY 1),
      r AS (SELECT qid, rank, min(struct_pack(pid := pid, dense := dense, bm25 := bm25, hybrid := hybrid)) AS s FROM retrieved GROUP BY 1, 2),
      g AS (SELECT qid, list(s.hybrid ORDER BY rank) FILTER (WHERE rank <= 5 AND isfinite(s.hybrid)) AS h0, list(s.hybrid ORDER BY rank) FILTER (WHERE rank <= 20 AND isfinite(s.hybrid)) AS w0, min(CASE WHEN rank = 1 THEN s.pid END) AS fp FROM r GROUP BY 1),
      h AS (SELECT qid, coalesce(h0, [0.0::DOUBLE]) AS h, CASE WHEN len(coalesce(w0, [])) > 1 THEN w0 ELSE coalesce(h0, [0.0::DOUBLE]) END AS w, fp FROM g),
      e AS (SELECT qid, sum((p / t) * ln(p / t + 1e-12)) AS neg FROM (SELECT qid, p, sum(p) OVER (PARTITION BY qid) AS t FROM (SELECT qid, unnest(w) - list_min(w) + 1e-9 AS p FROM h)) GROUP BY 1),
      m AS (SELECT h.*, e.neg, q1.question, {CONTENT('question')} AS cw, {WORDS('text')} AS lows FROM h JOIN e USING (qid) JOIN q1 USING (qid) LEFT JOIN tx ON tx.pid = fp)
      SELECT qid, round(h[1], 9) AS r_sim_top1, round(CASE WHEN len(h) > 1 THEN h[1] - h[2] ELSE h[1] END, 9) AS r_sim_margin, round(list_sum(h) / len(h), 9) AS r_sim_mean_k, round(-neg, 5) AS r_sim_entropy,
        round(CAST(len(list_filter(h, lambda x: x > 0.3)) AS DOUBLE), 5) AS r_n_above_tau, round(CASE WHEN len(cw) > 0 THEN len(list_filter(cw, lambda x: list_contains(lows, x))) / len(cw) ELSE 0 END, 5) AS r_lex_overlap,
        round(CAST(len(list_filter(regexp_split_to_array(question, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS DOUBLE), 5) AS r_q_len FROM m""",
    "gold_spans": f"""WITH {TOKENS}, {CANDIDATES}, tx AS (SELECT pid, start, len, {NORM("substring(text, c0 + 1, c1 - c0)")} AS norm FROM cand JOIN t0 USING (pid)),
      g AS (SELECT DISTINCT qid, pid, {NORM('gold')} AS norm FROM (SELECT qid, gold_pid AS pid, unnest(answers) AS gold FROM questions WHERE qid IS NOT NULL AND gold_pid IS NOT NULL AND answers IS NOT NULL))
      SELECT qid, count(DISTINCT (start, len)) AS spans, min(start) AS first_start FROM g JOIN tx USING (pid, norm) WHERE norm <> '' GROUP BY 1""",
    "evidence": f"""WITH {CORPUS}, tx AS (SELECT pid, min(struct_pack(article := article, text := text)) AS t FROM c GROUP BY 1), r AS (SELECT qid, rank, min(struct_pack(pid := pid, dense := dense, bm25 := bm25, hybrid := hybrid)) AS s FROM retrieved GROUP BY 1, 2)
      SELECT qid, rank, s.pid AS pid, t.article AS article, round(s.hybrid, 6) AS score, substr(t.text, 1, 400) AS shown FROM r LEFT JOIN tx ON tx.pid = s.pid WHERE rank <= 5""",
    "mask_faults": f"""WITH {BM25}, own AS (SELECT 'search' AS source, qid, pid FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM lex) WHERE rank <= 5
      UNION ALL SELECT DISTINCT 'table', qid, pid FROM retrieved WHERE qid IS NOT NULL AND pid IS NOT NULL)
      SELECT DISTINCT source, own.qid, own.pid FROM own JOIN c ON c.pid = own.pid JOIN q ON q.qid = own.qid WHERE c.article = q.article AND own.pid IS DISTINCT FROM q.gold_pid""",
}
SQL["training_spans"] = f"""WITH {TOKENS}, f AS ({SQL["span_features"]}), tx AS (SELECT pid, start, len, {NORM("substring(text, a.c0 + 1, b.c1 - a.c0)")} AS norm FROM (SELECT DISTINCT pid, start, len FROM f) JOIN t0 USING (pid) JOIN tok a USING (pid) JOIN tok b USING (pid) WHERE a.pos = start AND b.pos = start + len - 1),
  g AS (SELECT qid, max(coalesce(is_impossible, false)) AS imp, list_filter(list_transform(coalesce(any_value(answers), []), lambda x: {NORM('x')}), lambda x: x <> '') AS golds FROM questions WHERE qid IS NOT NULL GROUP BY 1),
  l AS (SELECT f.qid, f.pid, f.start, f.len, imp, golds, CAST(NOT imp AND list_contains(golds, norm) AS DOUBLE) AS label FROM f JOIN tx USING (pid, start, len) JOIN g USING (qid)),
  o AS (SELECT *, sum(label) OVER (PARTITION BY qid) AS pos FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY ('0x' || substr(md5('0|' || qid || '|' || start || '|' || len), 1, 8))::BIGINT, start, len) AS k FROM o WHERE imp OR len(golds) = 0 OR pos > 0),
  r AS (SELECT * FROM k WHERE label = 1 OR k <= 400 * greatest(pos, 1)), t AS (SELECT sum(label) AS p, count(*) AS n FROM r)
  SELECT qid, pid, start, len, label, round(CASE WHEN label = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END, 6) AS weight FROM r, t"""
QUERIES = [
    corpus_stats, term_idf, bm25_terms, tfidf_vectors, retrieve_bm25, retrieve_unmasked, retrieve_tfidf, retrieve_hybrid, fused_scores, retrieve_latent, gold_in_top, question_types,
    span_tokens, span_candidates, sentence_overlap, span_features, gold_spans, training_spans, retrieval_signals, evidence, mask_faults,
]
