"""Lexical and dense retrieval as relational tables: postings with weights, joined on terms.

A corpus is ``pid, article, text``, one row a passage; only passages with a word
can be found and count. Scores are rounded to six decimals before they are
ranked, and ties go to the lower ``pid``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import finite_or_zero, long_words, words
from quillspan.operators.skew import lookup, running
from quillspan.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Dimensions of the latent space.
DIMS = 256


def corpus(passages: DataFrame) -> DataFrame:
    """Different rows with a key and at least one word."""
    rows = passages.select("pid", "article", "text").where("pid IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.where(F.size(words(F.col("text"))) > 0)


def term_counts(texts: DataFrame, key: str, text: str, long: bool = False) -> DataFrame:
    """``key, term, tf``."""
    split = long_words if long else words
    return texts.select(key, F.explode(split(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(passages: DataFrame) -> DataFrame:
    """``term, df, idf`` with idf = ln(N / (1 + df)) + 1."""
    n = passages.count()
    counts = term_counts(passages, "pid", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("term", "df", (F.ln(F.lit(float(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def bm25_terms(counts: DataFrame, n: int) -> DataFrame:
    """``term, df, idf``: the probabilistic idf; negative ones become a quarter of the mean over all terms."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


def bm25_postings(passages: DataFrame) -> DataFrame:
    """``pid, article, term, weight``: what a word of a question adds to the score of the passage."""
    counts = materialize(term_counts(passages, "pid", "text"), "term-counts")
    lengths = counts.groupBy("pid").agg(F.sum("tf").alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = totals["n"], totals["avgdl"] or 1.0
    terms = bm25_terms(counts, n)
    rows = lookup(counts, terms, "term", "df").join(lengths, "pid").join(passages.select("pid", "article"), "pid")
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return rows.select("pid", "article", "term", weight.alias("weight"))


def tfidf_terms(counts: DataFrame, n: int, min_df: int = 2) -> DataFrame:
    """``term, df, idf`` with idf = ln((1 + n) / (1 + df)) + 1, for terms in at least ``min_df`` passages."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.select("term", "df", (F.ln(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``key, term, weight``: (1 + ln tf) idf, scaled to length 1."""
    rows = lookup(counts, terms, "term", "df").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Questions of a block and passages of a shard, at most about; score cells that are held at once.
BLOCK, SHARD, CELLS = 16_384, 4_096, 2_000_000


def _lists(rows: DataFrame, key: str) -> DataFrame:
    """``key, terms, weights`` from ``key, term, weight``."""
    packed = rows.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("_t"))
    return packed.select(key, F.col("_t.term").alias("terms"), F.col("_t.weight").alias("weights"))


def _met(held: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """``run(passages, questions)`` for every shard of the passages and every block of the questions, as Arrow tables.

    Both sides are joined on (shard, block): a shard's rows go to each block, a
    block's to each shard. All of it stays with the executors.
    """
    blocks = max(1, -(-asked.count() // BLOCK))
    shards = max(4 * held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // SHARD))
    left = held.withColumns({"_s": F.pmod(F.xxhash64("pid"), F.lit(shards)), "_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = asked.withColumns({"_b": F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"), "_s": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))})
    return left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInArrow(run, schema)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Sizes and values of a column of lists; null lists are empty."""
    whole = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


class Shard:
    """Passages of a shard in arrays, sorted by pid: postings by term, articles, vectors."""

    def __init__(self, held: pa.Table, asked: pa.Table) -> None:
        held = held.sort_by("pid")
        self.pids = held.column("pid").to_numpy()
        n, own = _flat(held.column("terms"))
        m, theirs = _flat(asked.column("terms"))
        codes = pa.chunked_array([own, theirs]).combine_chunks().dictionary_encode().indices.to_numpy()
        code, self.code = codes[: len(own)], codes[len(own) :]
        order = np.argsort(code, kind="stable")
        self.at, self.weight = np.repeat(np.arange(len(n)), n)[order], _flat(held.column("weights"))[1].to_numpy()[order]
        self.starts = np.searchsorted(code[order], np.arange(codes.max(initial=-1) + 2))
        #: Questions of the asked terms, and these terms' weights.
        self.row, self.asked = np.repeat(np.arange(len(m)), m), _flat(asked.column("weights"))[1].to_numpy()
        names = pa.chunked_array([*held.column("article").chunks, *asked.column("article").chunks], type=pa.string()).combine_chunks().dictionary_encode().indices
        names = pc.fill_null(names, -1).to_numpy(zero_copy_only=False)
        self.article, self.their_article = names[: len(n)], names[len(n) :]
        self.gold = pc.fill_null(asked.column("gold_pid"), -(2**63)).to_numpy()
        self.questions = len(m)
        self.vectors = _matrices([t.column("vec") for t in (held, asked)]) if "vec" in held.column_names else None

    def chunks(self) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS // max(1, len(self.pids)))
        return ((i, min(i + step, self.questions)) for i in range(0, self.questions if len(self.pids) else 0, step))

    def lexical(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """For questions i to j - 1 and all passages: do they share a term, and their sums of weights."""
        size = len(self.pids)
        a, b = np.searchsorted(self.row, [i, j])
        code = self.code[a:b]
        count = self.starts[code + 1] - self.starts[code]
        total, hit = np.zeros((j - i) * size), np.zeros((j - i) * size, dtype=bool)
        ends = np.cumsum(count)
        low = 0
        while low < len(code):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + 2 * CELLS, side="right")))
            c = count[low:high]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - self.starts[code[low:high]], c)
            cell = np.repeat((self.row[a + low : a + high] - i) * size, c) + self.at[at]
            total += np.bincount(cell, np.repeat(self.asked[a + low : a + high], c) * self.weight[at], minlength=len(total))
            hit[cell] = True
            low = high
        return hit.reshape(-1, size), np.round(total, DIGITS).reshape(-1, size)

    def dense(self, i: int, j: int) -> np.ndarray:
        held, asked = self.vectors
        return np.round((asked[i:j] @ held.T).astype(np.float64), DIGITS)

    def allowed(self, i: int, j: int) -> np.ndarray:
        """Passages that aren't siblings: of the question's own article only its gold passage counts; without an article all are allowed."""
        q = self.their_article[i:j, None]
        return (q != self.article[None]) | (q < 0) | (self.pids[None] == self.gold[i:j, None])


def _matrices(columns: list[pa.ChunkedArray]) -> list[np.ndarray]:
    """Packed vectors of 32-bit floats as rows of one width; what has none is 0."""
    held = [c.to_pylist() for c in columns]
    size = max((len(x) for side in held for x in side if x), default=4)
    return [np.frombuffer(b"".join(x or b"\0" * size for x in side), dtype=np.float32).reshape(len(side), size // 4) for side in held]


def _best(values: np.ndarray, ok: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest values that are ok in each row, equal ones by column."""
    if k is not None and values.shape[1] > k:
        v = np.where(ok, values, -np.inf)
        least = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k, None]
        above, level = v > least, (v == least) & ok
        room = k - above.sum(axis=1, keepdims=True)
        crowded = np.flatnonzero(level.sum(axis=1) > room[:, 0])
        level[crowded] &= np.cumsum(level[crowded], axis=1) <= room[crowded]
        ok = (above & ok) | level
    return np.nonzero(ok)


def score(asked: DataFrame, postings: DataFrame, questions: DataFrame, passages: DataFrame, masked: bool = True, k: int | None = None) -> DataFrame:
    """``qid, pid, score`` (and ``rank``, if the ``k`` best are asked for): sums of question weight times posting weight over equal terms.

    ``asked`` has ``qid, term, weight``; ``questions`` ``qid, article, gold_pid``.
    Each block of questions, a stated set, meets each shard of the passages, which
    adds up its postings in arrays and keeps its k best; these are merged. (As a
    join and an aggregation, each common term of a pair is a row.)
    """
    held = materialize(_lists(postings, "pid").join(passages.select("pid", "article").dropDuplicates(["pid"]), "pid"), "postings")
    wanted = materialize(_lists(asked, "qid").join(questions.select("qid", "article", "gold_pid"), "qid"), "asked")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right)
        rows, pids, values = [], [], []
        for i, j in shard.chunks():
            hit, s = shard.lexical(i, j)
            if masked:
                hit &= shard.allowed(i, j)
            r, c = _best(s, hit, k)
            rows.append(r + i)
            pids.append(shard.pids[c])
            values.append(s[r, c])
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return pa.table({"qid": right.column("qid").take(pa.array(at)), "pid": np.concatenate(pids) if pids else np.zeros(0, dtype=np.int64), "score": np.concatenate(values) if values else np.zeros(0)})

    found = _met(held, wanted, run, "qid string, pid long, score double")
    return found if k is None else top(found, k)


def top(scored: DataFrame, k: int, by: str = "score", group: str = "qid") -> DataFrame:
    """The k best passages of each question with ``rank`` from 1 on."""
    w = Window.partitionBy(group).orderBy(F.desc(by), "pid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def askable(questions: DataFrame) -> DataFrame:
    """``qid, article, gold_pid, question``: different rows with a key and a question."""
    return questions.select("qid", "article", "gold_pid", "question").where("qid IS NOT NULL AND question IS NOT NULL").distinct()


def bm25(passages: DataFrame, questions: DataFrame, masked: bool = True, k: int | None = None) -> DataFrame:
    """BM25 scores of every allowed passage that shares a word with the question; repeated question words count again."""
    asked = term_counts(questions, "qid", "question").select("qid", "term", F.col("tf").cast("double").alias("weight"))
    return score(asked, bm25_postings(passages), questions, passages, masked, k)


def tfidf_cosine(passages: DataFrame, questions: DataFrame, masked: bool = True, k: int | None = None) -> DataFrame:
    """Cosines of the TF-IDF vectors of questions and allowed passages, where they share a term."""
    counts = term_counts(passages, "pid", "text", long=True)
    terms = tfidf_terms(counts, passages.count())
    held = tfidf_vectors(counts, terms, "pid").join(passages.select("pid", "article"), "pid")
    asked = tfidf_vectors(term_counts(questions, "qid", "question", long=True), terms, "qid")
    return score(asked, held, questions, passages, masked, k)


def _packed(vectors: DataFrame) -> DataFrame:
    """``vec`` as the bytes of 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(vec: pd.Series) -> pd.Series:
        return vec.map(lambda x: np.asarray(x, dtype=np.float32).tobytes())

    return vectors.withColumn("vec", pack("vec"))


def hybrid(passages: DataFrame, questions: DataFrame, k: int, alpha: float = 0.5, masked: bool = True, dims: int = DIMS) -> DataFrame:
    """``qid, rank, pid, dense, bm25, hybrid``: the k best by the mixture of both scores, each scaled to 0..1 over a question's allowed passages.

    ``dense`` is the raw cosine in the latent space of ``dims`` dimensions, ``bm25``
    the scaled score. Every allowed passage takes part, whether it shares a word or
    not. Blocks of questions meet the shards twice: once for the limits of each
    question's scores, which are joined to the questions, and once for the mixture.
    """
    vectors, asked_vectors, _ = latent_vectors(passages, questions, dims)
    names = passages.select("pid", "article").dropDuplicates(["pid"])
    held = materialize(names.join(_lists(bm25_postings(passages), "pid"), "pid", "left").join(_packed(vectors), "pid", "left"), "hybrid-passages")
    asked = term_counts(questions, "qid", "question").select("qid", "term", F.col("tf").cast("double").alias("weight"))
    wanted = materialize(questions.select("qid", "article", "gold_pid").join(_lists(asked, "qid"), "qid", "left").join(_packed(asked_vectors), "qid", "left"), "hybrid-questions")

    def parts(shard: Shard) -> Iterator[tuple]:
        for i, j in shard.chunks():
            free = shard.allowed(i, j) if masked else np.ones((j - i, len(shard.pids)), dtype=bool)
            yield i, free, shard.dense(i, j), shard.lexical(i, j)[1]

    def limits(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, out = Shard(left, right), []
        for i, free, d, w in parts(shard):
            ends = [f(np.where(free, v, fill), axis=1) for v in (d, w) for f, fill in ((np.min, np.inf), (np.max, -np.inf))]
            out.append(np.stack([np.arange(i, i + len(d)), *ends])[:, free.any(axis=1)])
        rows = np.concatenate(out, axis=1) if out else np.zeros((5, 0))
        return pa.table({"qid": right.column("qid").take(pa.array(rows[0].astype(np.int64))), **dict(zip(("d0", "d1", "w0", "w1"), rows[1:]))})

    ends = _met(held, wanted, limits, "qid string, d0 double, d1 double, w0 double, w1 double")
    ends = ends.groupBy("qid").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("w0").alias("w0"), F.max("w1").alias("w1"))
    scaled = materialize(wanted.join(ends.hint("merge"), "qid"), "hybrid-limits")

    def mix(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right)
        d0, d1, w0, w1 = (right.column(c).to_numpy()[:, None] for c in ("d0", "d1", "w0", "w1"))
        rows, columns = [], []
        for i, free, d, w in parts(shard):
            at = slice(i, i + len(d))
            lexical = (w - w0[at]) / (w1[at] - w0[at] + 1e-9)
            both = np.round(alpha * ((d - d0[at]) / (d1[at] - d0[at] + 1e-9)) + (1 - alpha) * lexical, DIGITS)
            r, c = _best(both, free, k)
            rows.append(r + i)
            columns.append((shard.pids[c], d[r, c], np.round(lexical[r, c], DIGITS), both[r, c]))
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        pid, dense, bm25_, mixed = (np.concatenate(c) for c in zip(*columns)) if columns else (np.zeros(0, dtype=np.int64), *[np.zeros(0)] * 3)
        return pa.table({"qid": right.column("qid").take(pa.array(at)), "pid": pid, "dense": dense, "bm25": bm25_, "hybrid": mixed})

    found = _met(held, scaled, mix, "qid string, pid long, dense double, bm25 double, hybrid double")
    return top(found, k, "hybrid").select("qid", "rank", "pid", "dense", "bm25", "hybrid")


def fuse(scores: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """``qid, rank, pid, dense, bm25, hybrid``: the same mixture for given scores (``qid, pid, dense, bm25``): each scaled to 0..1 over a question's passages; scores that aren't finite count as 0."""
    w = Window.partitionBy("qid")
    d, b = finite_or_zero(F.col("dense")), finite_or_zero(F.col("bm25"))
    rows = scores.select("qid", "pid", d.alias("dense"), b.alias("_b"))
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)
    mixed = rows.select("qid", "pid", "dense", scale("_b").alias("bm25"), scale("dense").alias("_d"))
    out = mixed.select("qid", "pid", "dense", F.round("bm25", DIGITS).alias("bm25"), F.round(alpha * F.col("_d") + (1 - alpha) * F.col("bm25"), DIGITS).alias("hybrid"))
    return top(out, k, "hybrid").select("qid", "rank", "pid", "dense", "bm25", "hybrid")


#: Rows of the term matrix that are sent in one piece.
PIECE = 2048


def _gram_times(held: DataFrame, q: np.ndarray, fan_in: int = 16) -> np.ndarray:
    """A'(A q) for the sparse rows ``js, ws`` of ``held``: one pass; partitions' sums are merged piece by piece in a tree."""
    width, size = q.shape
    sent = held.sparkSession.sparkContext.broadcast(q)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros((width, size))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                n = pc.list_value_length(piece.column(0)).to_numpy(zero_copy_only=False)
                j, w = (piece.column(c).flatten().to_numpy() for c in (0, 1))
                if not len(j):
                    continue
                # rows times q, one after another; then each row's product goes back to its columns, gathered by column
                known = sent.value[j] * w[:, None]
                full = np.flatnonzero(n)
                product = np.zeros((len(n), size))
                product[full] = np.add.reduceat(known, (np.cumsum(n) - n)[full], axis=0)
                order = np.argsort(j, kind="stable")
                back = product[np.repeat(np.arange(len(n)), n)[order]] * w[order, None]
                first = np.flatnonzero(np.r_[True, j[order][1:] != j[order][:-1]])
                out[j[order][first]] += np.add.reduceat(back, first, axis=0)
        for r, i in enumerate(range(0, width, PIECE)):
            yield pa.RecordBatch.from_pydict({"b": [TaskContext.get().partitionId()], "r": [r], "m": [out[i : i + PIECE].tobytes()]}, schema=pa.schema([("b", pa.int64()), ("r", pa.int64()), ("m", pa.binary())]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        total = sum(np.frombuffer(m) for m in frame["m"])
        return pd.DataFrame({"b": [frame["b"].iloc[0] // fan_in], "r": [frame["r"].iloc[0]], "m": [total.tobytes()]})

    parts = max(1, held.rdd.getNumPartitions())
    sums = held.select("js", "ws").mapInArrow(part, "b long, r long, m binary")
    while parts > 1:
        parts = -(-parts // fan_in)
        sums = sums.groupBy("r", F.floor(F.col("b") / fan_in)).applyInPandas(merge, "b long, r long, m binary")
    out = np.zeros((width, size))
    for row in sums.toLocalIterator():  # one matrix of the vocabulary by the dimensions
        piece = np.frombuffer(row["m"]).reshape(-1, size)
        out[row["r"] * PIECE : row["r"] * PIECE + len(piece)] += piece
    sent.unpersist()
    return out


def latent_vectors(passages: DataFrame, questions: DataFrame, dims: int = DIMS, rounds: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """``(pid vectors, qid vectors, k)``: truncated SVD of the TF-IDF matrix, rows scaled to length 1.

    Randomised: a random start of dims + 10 columns is multiplied by A'A and made
    orthogonal ``rounds`` times, one pass over the passages each; the projected
    problem is solved on the driver. The term matrix V (vocabulary by dims) is the
    model: the driver holds it and the workers get it.
    """
    counts = materialize(term_counts(passages, "pid", "text", long=True), "long-counts")
    terms = tfidf_terms(counts, passages.count())
    numbered = running(terms.select("term", F.lit(0).alias("_g")), ["_g"], ["term"], {}).select("term", (F.col("rn") - 1).alias("j"))
    numbered = materialize(numbered, "vocabulary")  # V is indexed by it
    width = numbered.count()

    def packed(rows: DataFrame, key: str) -> DataFrame:
        lists = rows.join(numbered, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("j", "weight"))).alias("_v"))
        return lists.select(key, F.col("_v.j").alias("js"), F.col("_v.weight").alias("ws"))

    held = materialize(packed(tfidf_vectors(counts, terms, "pid"), "pid"), "tfidf-rows")
    asked = packed(tfidf_vectors(term_counts(questions, "qid", "question", long=True), terms, "qid"), "qid")
    k = max(1, min(dims, held.count() - 1, width - 1))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, k + 10))))[0]
    for _ in range(rounds if width else 0):
        q = np.linalg.qr(_gram_times(held, q))[0]
    values, vectors = np.linalg.eigh(q.T @ _gram_times(held, q)) if width else (np.zeros(0), np.zeros((0, 0)))
    v = q @ vectors[:, np.argsort(-values)[:k]]
    sent = passages.sparkSession.sparkContext.broadcast(v)

    def project(frame: DataFrame, key: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def unit(js: pd.Series, ws: pd.Series) -> pd.Series:
            out = []
            for j, w in zip(js, ws):
                p = np.asarray(w) @ sent.value[np.asarray(j)]
                norm = np.linalg.norm(p)
                out.append((p / norm if norm else p).astype(np.float32))
            return pd.Series(out)

        return frame.select(key, unit("js", "ws").alias("vec"))

    return project(held, "pid"), project(asked, "qid"), k


def nearest(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``qid, pid, score, rank``: the k passages with the highest cosine for each question, exactly: blocks of questions meet all shards."""
    none = F.array().cast("array<string>"), F.array().cast("array<double>")
    bare = lambda rows: _packed(rows).withColumns({"terms": none[0], "weights": none[1], "article": F.lit(None).cast("string")})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, rows, pids, values = Shard(left, right), [], [], []
        for i, j in shard.chunks():
            s = shard.dense(i, j)
            r, c = _best(s, np.ones(s.shape, dtype=bool), k)
            rows.append(r + i)
            pids.append(shard.pids[c])
            values.append(s[r, c])
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return pa.table({"qid": right.column("qid").take(pa.array(at)), "pid": np.concatenate(pids) if pids else np.zeros(0, dtype=np.int64), "score": np.concatenate(values) if values else np.zeros(0)})

    wanted = materialize(bare(asked).withColumn("gold_pid", F.lit(None).cast("long")), "nearest-asked")
    return top(_met(materialize(bare(held), "nearest-held"), wanted, run, "qid string, pid long, score double"), k)


class Index:
    """The fitted tables of a corpus for lexical search, to be written once and read by many runs."""

    def __init__(self, passages: DataFrame, postings: DataFrame) -> None:
        self.passages, self.postings = passages, postings

    @classmethod
    def build(cls, passages: DataFrame) -> Index:
        return cls(passages.select("pid", "article", "text"), bm25_postings(passages))

    def save(self, path: str) -> None:
        self.passages.write.mode("overwrite").parquet(f"{path}/passages")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/passages"), spark.read.parquet(f"{path}/postings"))

    def search(self, questions: DataFrame, k: int, masked: bool = True) -> DataFrame:
        asked = term_counts(questions, "qid", "question").select("qid", "term", F.col("tf").cast("double").alias("weight"))
        return score(asked, self.postings, questions, self.passages, masked, k)
