"""Filling fixed-capacity bins with whole documents (problem 9).

Method: shortest-pack-first over the length histogram. Lengths are placed
longest first; a length goes into the open pack that is filled least, for all
packs of one pattern at once, so that the work depends on the capacity and not
on the number of documents. Patterns are then joined back to the documents by
each document's rank among those of its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.skew import rank_in_group
from quillspan.session import materialize

#: Pieces of one part when the pieces of one length are numbered.
ROWS_A_PART = 2_000_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (number of packs, {length: pieces in each}); lengths from 1 to the capacity.

    Among the open packs with room, the one with most room left is taken (the
    shortest pack first), of those the one opened last. Every piece is placed.
    """
    parent: list[tuple[int, int, int]] = [(-1, 0, 0)]  # a pattern: the pattern before, the length added, how often
    open_: dict[int, list[list[int]]] = defaultdict(list)  # by room left: [packs, pattern]
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(count: int, pattern: int, room: int) -> None:
        open_[room].append([count, pattern])
        rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} in bins of {capacity}")
        while left > 0:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting) == 0:
                each = capacity // length  # new packs, each with as many of this length as go in
                each = min(each, left)
                packs = left // each
                parent.append((0, length, each))
                put(packs, len(parent) - 1, capacity - each * length)
                left -= packs * each
                continue
            room = length + int(fitting[-1])
            count, pattern = open_[room][-1]
            each = min(room // length, max(1, left // count))
            packs = min(count, left // each)
            if packs == count:
                open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                open_[room][-1][0] = count - packs
            parent.append((pattern, length, each))
            put(packs, len(parent) - 1, room - each * length)
            left -= packs * each
    out = []
    for packs_of in open_.values():
        for count, pattern in packs_of:
            lengths: dict[int, int] = defaultdict(int)
            while pattern:
                pattern, length, each = parent[pattern]
                lengths[length] += each
            out.append((count, dict(lengths)))
    return out


class Plan:
    """Which bin a piece goes to, by its length and its rank among pieces of that length."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]) -> None:
        spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first bin, packs
        taken: dict[int, int] = defaultdict(int)
        self.bins = 0
        for count, lengths in patterns:
            for length, each in lengths.items():
                spans[length].append((taken[length], self.bins, count))
                taken[length] += each * count
            self.bins += count
        self.spans = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for n, rows in spans.items()}

    def bin_of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(length), dtype=np.int64)  # pieces without tokens take no room: they go to bin 0
        for n in np.unique(length):
            if n > 0:
                first, start, packs = self.spans[int(n)]
                at = length == n
                k = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = start[k] + (rank[at] - first[k]) % packs[k]
        return out


def pieces(lengths: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Cut documents larger than the bin into full pieces and a rest; others stay whole.

    Columns: the key, ``piece`` from 0, ``n_pieces``, ``piece_start`` and ``piece_tokens``. A null size counts as 0.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    return (
        lengths.select(key, n.alias("_n"), F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("long").alias("n_pieces"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
        .withColumn("piece_start", F.col("piece") * capacity)
        .withColumn("piece_tokens", F.least(F.col("_n") - F.col("piece_start"), F.lit(capacity)).cast("int"))
        .drop("_n")
    )


def pack(lengths: DataFrame, key: str, size: str, bins: list[tuple[str, int]], salts: int | None = None) -> DataFrame:
    """Put all documents into bins of each kind.

    ``lengths`` has one row a document (``key`` unique and not null, ``size`` in
    tokens); ``bins`` are (name, capacity). The result has a row for each piece:
    ``bin_name, bin_id`` (from 0), the key, ``piece, n_pieces, piece_start,
    piece_tokens``. Documents without tokens are in bin 0 and take no room.

    Only histograms, of at most the capacity's number of rows, go to the driver.
    """
    spark = lengths.sparkSession
    out = None
    for name, capacity in bins:
        if capacity < 1:
            raise ValueError(f"bin {name!r} has no capacity")
        cut = pieces(lengths, key, size, capacity)
        rows = cut.groupBy("piece_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
        histogram = {r["piece_tokens"]: r["n"] for r in rows if r["piece_tokens"] > 0}
        plan = spark.sparkContext.broadcast(Plan(pack_histogram(histogram, capacity)))
        parts = salts or max(1, -(-sum(r["n"] for r in rows) // ROWS_A_PART))
        ranked = rank_in_group(cut, ["piece_tokens"], [key, "piece"], parts, "_rank")

        def place(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = plan.value.bin_of(batch.column("piece_tokens").to_numpy(), batch.column("_rank").to_numpy())
                columns = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
                yield pa.RecordBatch.from_pydict({**columns, "bin_id": pa.array(at)})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", bin_id long"
        placed = ranked.mapInArrow(place, schema).select(F.lit(name).alias("bin_name"), "bin_id", key, "piece", "n_pieces", "piece_start", "piece_tokens")
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        raise ValueError("no bins")
    return out


def fill_report(packed: DataFrame, bins: list[tuple[str, int]]) -> DataFrame:
    """For each kind of bin: bins used, the least number possible by volume, and the share of room that is filled."""
    by_bin = packed.groupBy("bin_name", "bin_id").agg(F.sum("piece_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    room = F.coalesce(*[F.when(F.col("bin_name") == n, F.lit(c)) for n, c in bins])
    return (
        by_bin.groupBy("bin_name")
        .agg(F.count(F.lit(1)).alias("n_bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"))
        .withColumn("least_bins", F.greatest(F.ceil(F.col("tokens") / room), F.lit(1)))
        .withColumn("filled", F.col("tokens") / (F.col("n_bins") * room))
    )


def token_lengths(docs: DataFrame, key: str, text: str, **encoding) -> DataFrame:
    """Key and ``n_tokens`` of each document, written once and read by each kind of bin."""
    from quillspan.llm.tokens import encode_documents

    return materialize(encode_documents(docs, key, text, ids=None, count="n_tokens", **encoding), "token-lengths")
