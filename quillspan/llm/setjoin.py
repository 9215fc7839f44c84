"""Exact similarity joins of texts as sets of character runs: what problems 1 and 7 share.

* Texts with equal sets form one class; only classes are joined.
* The global order of runs is by frequency, rarest first. Frequencies come from a
  table with a byte for each bucket of runs, the logarithm of its count; there are
  about as many buckets as a quarter of the corpus's runs, up to 2**26 (64 MB).
  Any total order makes the filters exact, this one makes them sharp.
* Runs that more than one in 2**18 of all occurrences are (and more than PART) are
  counted exactly; there are fewer than 2**18 of them at every size of the corpus.
  Only their postings are dealt to several lists, so that no task gets a long list
  alone.
* Postings are brought together by one shuffle on the run (and list), sorted by it,
  and met list by list in arrays: nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.chars import mix, run_sets

#: Characters of a run; similarity from which texts are a pair (as a fraction).
RUN, NUMERATOR, DENOMINATOR = 4, 3, 5
#: Least and greatest number of buckets, as powers of two, and buckets of one piece of the table.
LEAST_BITS, MOST_BITS, PIECE_BITS = 16, 26, 14
#: Steps of the table's logarithm in an octave.
STEPS = 8
#: Postings of a run in one list, about.
PART = 4096
#: 64-bit words of a sketch.
WORDS = 4
#: Postings that meet at once, and pairs that are looked at together.
TOGETHER, PAIRS = 200_000, 250_000
_KEY, _BIN = 0xD6E8FEB86659FD93, np.uint64(0x5851F42D4C957F2D)
SKETCH = ", ".join(f"s{w} bigint" for w in range(WORDS))


def spread(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: it is shuffled and sorted, never broadcast by a guess at its size."""
    return rows.hint("merge")


def pieces(batches: Iterator[pa.RecordBatch], lengths: int, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``rows`` rows and about ``most`` characters or elements of column ``lengths``."""
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(lengths)
        n = pc.fill_null(pc.utf8_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length(column), 0)
        total = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            done = total[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(total, done + most, side="right"))), i + rows)
            yield batch.slice(i, j - i)
            i = j


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and the flat values of a column of arrays of numbers without nulls, slices included."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.to_numpy()[offsets[0] : offsets[-1]]


def text_sets(texts: DataFrame, keys: list[str], text: str, space: str | None = None, n: int = RUN) -> DataFrame:
    """The keys, ``sig`` (128-bit digest of the set of runs) and ``grams`` (ascending hashes), for texts with a run.

    ``space`` names a column whose values keep their sets apart. Texts without a
    run (null, empty, blank, marks only, fewer than ``n`` letters and digits)
    are similar to none and don't appear.
    """
    columns = [*keys, *[space] * (space is not None and space not in keys), text]
    at = columns.index(text)
    other = columns.index(space) if space else None
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*columns[:-1]).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in pieces(batches, at):
            salts = None
            if other is not None:
                spaces = part.column(other).to_pylist()
                for s in set(spaces) - known.keys():
                    known[s] = int.from_bytes(hashlib.blake2b(str(s).encode(), digest_size=8).digest(), "little")
                salts = np.array([known[s] for s in spaces], dtype=np.uint64)
            sizes, grams = run_sets(part.column(at).to_pylist(), n, salts)
            keep = np.flatnonzero(sizes)
            if len(keep):
                ends = np.cumsum(sizes[keep])
                raw, starts = grams.tobytes(), np.r_[0, ends[:-1]]
                sigs = [hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist())]
                kept = part.take(pa.array(keep))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(sigs, type=pa.binary()), lists], names=[*columns[:-1], "sig", "grams"])

    return texts.select(*columns).mapInArrow(run, ", ".join([*fields, "sig binary", "grams array<bigint>"]))


def classes_of(sets: DataFrame, *more: Column) -> DataFrame:
    """A row for each different set: a number ``id``, ``sig``, ``n``, ``grams`` and the aggregates asked for. The numbers hold once this is written."""
    return sets.groupBy("sig").agg(F.first("grams").alias("grams"), *more).withColumn("n", F.size("grams")).withColumn("id", F.monotonically_increasing_id())


class Order(NamedTuple):
    """The global order of runs: by ``level`` of their bucket, then by value; and the runs that are frequent by exact count."""

    bits: int
    levels: np.ndarray
    frequent: np.ndarray
    lists: np.ndarray

    def level(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[bucket_of(grams, self.bits)]

    def times(self, grams: np.ndarray) -> np.ndarray:
        """The number of lists that the postings of each run are dealt to."""
        out = np.ones(len(grams), dtype=np.int64)
        if len(self.frequent):
            value = grams.view(np.int64)
            at = np.minimum(np.searchsorted(self.frequent, value), len(self.frequent) - 1)
            known = self.frequent[at] == value
            out[known] = self.lists[at[known]]
        return out


def bucket_of(gram: np.ndarray, bits: int) -> np.ndarray:
    return (mix(gram.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def global_order(classes: DataFrame, bits: int | None = None, part: int = PART) -> Broadcast:
    """Count the runs of all classes: the table by bucket, whose size follows from ``n``, and exact counts of frequent runs."""
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    bits = bits or min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(total, 1)))) - 2))
    size = 1 << min(bits, PIECE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        waiting: list[np.ndarray] = []

        def add() -> None:
            counts.__iadd__(np.bincount(np.concatenate(waiting), minlength=1 << bits))
            waiting.clear()

        for batch in batches:
            waiting.append(bucket_of(lists_of(batch.column(0))[1], bits).astype(np.int32))
            if sum(map(len, waiting)) > 1 << bits:
                add()
        if waiting:
            add()
        for k in range(0, 1 << bits, size):
            if counts[k : k + size].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // size], type=pa.int32()), "counts": pa.array([counts[k : k + size].tobytes()], type=pa.binary())})

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, dtype=np.int64) for c in frame["counts"])
        steps = np.where(counts > 0, np.minimum(255, np.ceil(STEPS * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)
        return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "levels": [steps.tobytes()]})

    levels = np.zeros(1 << bits, dtype=np.uint8)
    for row in classes.select("grams").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInPandas(level, "piece int, levels binary").toLocalIterator():
        levels[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["levels"], dtype=np.uint8)  # 2**bits bytes in all
    most = max(part, total >> 18)
    high = int(np.floor(STEPS * np.log2(most)))
    frequent, lists = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    spark = classes.sparkSession
    if levels.max(initial=0) >= high:
        sent = spark.sparkContext.broadcast(levels >= high)

        def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, grams = lists_of(batch.column(0))
                runs, n = np.unique(grams[sent.value[bucket_of(grams, bits)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n)], names=["run", "n"])

        exact = classes.select("grams").mapInArrow(crowded, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > most).toPandas().sort_values("run")  # fewer than 2**18 rows
        frequent, lists = exact["run"].to_numpy(np.int64), -(-exact["n"].to_numpy(np.int64) // most)
    return spark.sparkContext.broadcast(Order(bits, levels, frequent, lists))


def needed(a, b, p: int = NUMERATOR, q: int = DENOMINATOR):
    """The least overlap of sets of these sizes with similarity of at least p/q: ceil(p (a + b) / (p + q))."""
    return (p * (a + b) + (p + q - 1)) // (p + q)


def sketches_of(part: np.ndarray, grams: np.ndarray, parts: int) -> np.ndarray:
    """For each part the parities of its runs in 256 bins: the symmetric difference of two sets has at least as many runs as their sketches have differing bits."""
    width = 64 * WORDS
    cell = part * width + (mix(grams.view(np.uint64) ^ _BIN) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(cell, minlength=parts * width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(-1, WORDS)


def run_keys(grams: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    """A key of 63 bits for each run and salt."""
    return ((mix(grams.view(np.uint64) ^ np.uint64(_KEY)) ^ mix(np.asarray(salt, dtype=np.uint64) + np.uint64(1))) >> np.uint64(1)).astype(np.int64)


def dealt(times: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Repeat each place ``times`` times, with a running number, in portions of about ``most``."""
    yield from expand(np.zeros(len(times), dtype=np.int64), times, most)


def expand(first: np.ndarray, count: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places k with each of first[k], ..., first[k] + count[k] - 1, in portions of about ``most`` pairs."""
    total = np.cumsum(count)
    low = 0
    while low < len(count):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + most, side="right")))
        c = count[low:high]
        n = int(c.sum())
        if n:
            yield np.repeat(np.arange(low, high), c), np.arange(n) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[low:high], c)
        low = high


def meet(postings: DataFrame, order: list[str], prepare: Callable, partners: Callable, admitted: Callable, extra: str = "") -> DataFrame:
    """``id_x, id_y`` (and the columns of ``extra``) for the postings that meet in a list and are admitted.

    ``postings`` have ``key, id, ...`` with key >> 1 naming the list. They are
    brought together and sorted by key and ``order``; a list goes through a task in
    portions, and each portion of pairs is filtered in arrays. ``prepare`` makes
    arrays of the sorted columns; ``partners`` gives the first partner and the
    number of partners of each posting, ``admitted`` the pairs (x, y) that stay, as
    arrays of the output's columns.
    """
    columns = postings.columns
    names = ["id_x", "id_y", *[c.split()[0] for c in extra.split(",") if c]]

    def work(held: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        stop = len(key) if last else int(np.searchsorted(key >> 1, key[-1] >> 1))  # the last list may go on
        rest = table.slice(stop).combine_chunks().to_batches()
        if not stop:
            return [], rest
        arrays = prepare({c: table.column(c).slice(0, stop).to_numpy() for c in columns})
        out = []
        for x, y in expand(*partners(arrays)):
            found = admitted(arrays, x, y)
            if len(found[0]):
                out.append(pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=names))
        return out, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = wanted = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > wanted + TOGETHER:
                out, held = work(held, False)
                size = wanted = sum(b.num_rows for b in held)  # what is left of a list waits for as much again
                yield from out
        if held:
            yield from work(held, True)[0]

    sorted_ = postings.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", *map(F.expr, order))
    return sorted_.mapInArrow(run, "id_x bigint, id_y bigint" + (f", {extra}" if extra else ""))


def ranked(key: np.ndarray) -> np.ndarray:
    """The running number of each of the sorted keys."""
    return np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64)


def differing(columns: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of x and y differ."""
    out = np.zeros(len(x), dtype=np.int32)
    for w in range(WORDS):
        s = columns[f"s{w}"].view(np.uint64)
        out += np.bitwise_count(s[x] ^ s[y])
    return out
