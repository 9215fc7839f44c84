"""Nearly equal records with small edits (problem 7).

Method: vertical partitioning. The global order of runs is cut into fragments, of
about equal shares of all runs. Pairs are found fragment by fragment: each fragment
that a set's prefix reaches is joined as a whole, under bounds for the lengths
before, in and after the fragment, and gives the exact overlap of the two sets in
that fragment. These partial overlaps are summed per pair; a pair whose sum can't
reach the threshold with all that follows is dropped, and the fragments that follow
are counted, one by one too, for those that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import setjoin
from quillspan.llm.chars import mix
from quillspan.llm.forest import components
from quillspan.llm.setjoin import DENOMINATOR, NUMERATOR, WORDS, spread
from quillspan.session import materialize

#: Fragments that the global order is cut into.
FRAGMENTS = 16


def cuts_of(order: setjoin.Order, pieces: int) -> np.ndarray:
    """The fragment of each level of the order, so that fragments hold about equal shares of all runs; runs of one level stay together."""
    weight = np.bincount(order.levels, minlength=256) * 2.0 ** (np.arange(256) / setjoin.STEPS)
    weight[0] = 0
    before = np.cumsum(weight) - weight / 2
    return np.minimum(pieces - 1, before * pieces // max(weight.sum(), 1.0)).astype(np.int64)


def cut(classes: DataFrame, order: Broadcast, pieces: int, p: int = NUMERATOR, q: int = DENOMINATOR) -> DataFrame:
    """``id, sig, n, ordered, ends, short, long``: the runs of each class in global order, and where its fragments end.

    A set of n runs that is similar to one of its size or more shares one of its
    first n - ceil(2 p n / (p + q)) + 1 runs with it, one that is similar to a
    smaller one one of its first n - ceil(p n / q) + 1. ``short`` and ``long`` are
    the last fragments that these prefixes reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        of_level = cuts_of(known, pieces)
        for batch in setjoin.pieces(batches, 2):
            size, grams = setjoin.lists_of(batch.column(2))
            row = np.repeat(np.arange(len(size)), size)
            level = known.level(grams)
            by = np.argsort((row << 8) | level, kind="stable")
            ends = np.cumsum(np.bincount(row * pieces + of_level[level], minlength=len(size) * pieces).reshape(-1, pieces), axis=1)
            last = lambda need: (ends <= (size - need)[:, None]).sum(axis=1)  # noqa: E731  the fragment that holds the prefix's last run
            lists = lambda flat, each: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), lists(grams[by], size), lists(ends.reshape(-1).astype(np.int32), np.full(len(size), pieces)), pa.array(last(setjoin.needed(size, size, p, q)).astype(np.int32)), pa.array(last((p * size + q - 1) // q).astype(np.int32))],
                names=["id", "sig", "n", "ordered", "ends", "short", "long"],
            )

    return classes.select("id", "sig", "grams").mapInArrow(run, "id bigint, sig binary, n int, ordered array<bigint>, ends array<int>, short int, long int")


def postings(pieces: DataFrame, order: Broadcast) -> DataFrame:
    """``key, id, meta, seg, s0..s3`` for every run of the fragments that a set's longer prefix reaches.

    ``meta`` packs the set's size, the fragment, and whether the shorter prefix
    reaches it; ``seg`` the runs before and in the fragment. A frequent run is
    dealt to blocks; each two of its blocks have a list, and in that of different
    blocks only postings of different blocks meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for batch in setjoin.pieces(batches, 1):
            ids, short, long = (batch.column(c).to_numpy() for c in (0, 3, 4))
            size, grams = setjoin.lists_of(batch.column(1))
            count, flat = setjoin.lists_of(batch.column(2))
            ends = flat.reshape(len(size), -1).astype(np.int64) if len(size) else np.zeros((0, 1), dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            sketches = setjoin.sketches_of(row, grams, len(size))
            pos = np.arange(len(grams)) - (np.cumsum(size) - size)[row]
            keep = (pos < ends[np.arange(len(size)), long][row]) & (known.level(grams) > 0)  # a run that one class alone has meets nothing
            row, gram, pos = row[keep], grams[keep], pos[keep]
            fragment = (ends[row] <= pos[:, None]).sum(axis=1)
            head = np.where(fragment > 0, ends[row, np.maximum(fragment - 1, 0)], 0)
            seg = (head << 32) | (ends[row, fragment] - head)
            meta = (size[row].astype(np.int64) << 32) | (fragment << 8) | (fragment <= short[row])
            times = known.times(gram)
            block = (mix(ids[row]) >> np.uint64(1)).astype(np.int64) % times
            for k, other in setjoin.dealt(times):
                low, high = np.minimum(block[k], other), np.maximum(block[k], other)
                key = setjoin.run_keys(gram[k], (low << 32) | high) << 1
                flags = ((low == high).astype(np.int64) << 1) | ((block[k] == high).astype(np.int64) << 2)
                at = row[k]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at]), pa.array(meta[k] | flags), pa.array(seg[k]), *[pa.array(sketches[at, w]) for w in range(WORDS)]], names=["key", "id", "meta", "seg", *[f"s{w}" for w in range(WORDS)]])

    return pieces.select("id", "ordered", "ends", "short", "long").mapInArrow(run, f"key bigint, id bigint, meta bigint, seg bigint, {setjoin.SKETCH}")


def prepared(c: dict[str, np.ndarray], p: int = NUMERATOR, q: int = DENOMINATOR) -> dict[str, np.ndarray]:
    """The fields of sorted postings: sizes, runs before and in the fragment, flags."""
    meta, seg = c["meta"], c["seg"]
    n, before, there = meta >> 32, seg >> 32, seg & 0xFFFFFFFF
    place = (setjoin.ranked(c["key"]) << 32) | n
    small = lambda v: v.astype(np.int32)
    return c | {"place": place, "upto": place - n + n * q // p, "n": small(n), "before": small(before), "there": small(there), "after": small(n - before - there), "flags": small(meta & 7), "fragment": small(meta >> 8 & 0xFF)}


def within(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The partners of each posting whose shorter prefix reaches the fragment: those that follow it in its list, which is sorted by size and class, up to the greatest size that a pair allows."""
    here = np.arange(len(c["place"]))
    return here + 1, np.where(c["flags"] & 1 > 0, np.searchsorted(c["place"], c["upto"], side="right") - here - 1, 0)


def admitted(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, p: int = NUMERATOR, q: int = DENOMINATOR) -> tuple[np.ndarray, ...]:
    """Of postings that meet, the classes (the smaller first) that can be a pair, with the fragment.

    Length: the two sets may differ in at most a + b - 2 need runs, and they differ
    at least by the differences of what they have before, in and after the
    fragment. Sketches: as many differing bits at most.
    """
    both = c["n"][x] + c["n"][y]
    most = both - 2 * setjoin.needed(both, 0, p, q)
    apart = sum(np.abs(c[f][x] - c[f][y]) for f in ("before", "there", "after"))
    ok = np.flatnonzero(apart <= most)
    x, y, most = x[ok], y[ok], most[ok]
    ok = np.flatnonzero(setjoin.differing(c, x, y) <= most)
    x, y = x[ok], y[ok]
    flags = c["flags"]
    ok = (flags[x] & 2 > 0) | ((flags[x] ^ flags[y]) & 4 > 0)
    x, y = x[ok], y[ok]
    return c["id"][x], c["id"][y], c["fragment"][x]


def _need(a: str, b: str, p: int = NUMERATOR, q: int = DENOMINATOR) -> Column:
    return F.floor((F.lit(p) * (F.col(a) + F.col(b)) + (p + q - 1)) / F.lit(p + q)).cast("int")


def links_of(pieces: DataFrame, order: Broadcast, count: int) -> DataFrame:
    """``sig_x, sig_y, similarity`` of every pair of different classes that reach the threshold."""
    met = setjoin.meet(postings(pieces, order), ["shiftright(meta, 32)", "id"], prepared, within, admitted, "fragment int")
    partial = met.groupBy("id_x", "id_y", "fragment").agg(F.count(F.lit(1)).cast("int").alias("overlap"))
    summed = partial.groupBy("id_x", "id_y").agg(F.sum("overlap").cast("int").alias("head"))
    summed = materialize(summed, "neardup-partial")
    side = lambda s: pieces.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "sig", "n", "ordered", "ends", "short", "long")])
    both = spread(summed).join(side("x"), "id_x").join(spread(side("y")), "id_y")
    # what both have in the fragments up to this one has been counted
    last = F.least("short_x", "long_y")
    left = lambda s: F.col(f"n_{s}") - F.get(F.col(f"ends_{s}"), last)
    hopeful = both.where(F.col("head") + F.least(left("x"), left("y")) >= _need("n_x", "n_y"))
    part = lambda s, f: F.slice(F.col(f"ordered_{s}"), F.get(F.col(f"ends_{s}"), f - 1) + 1, F.get(F.col(f"ends_{s}"), f) - F.get(F.col(f"ends_{s}"), f - 1))
    following = F.when(last < count - 1, F.sequence(last + 1, F.lit(count - 1))).otherwise(F.array().cast("array<int>"))
    # fragment by fragment, as long as what follows can still reach the threshold
    total = F.aggregate(
        following,
        F.col("head"),
        lambda sum_, f: F.when(sum_ + F.least(*[F.col(f"n_{s}") - F.get(F.col(f"ends_{s}"), f - 1) for s in "xy"]) < _need("n_x", "n_y"), sum_).otherwise(sum_ + F.size(F.array_intersect(part("x", f), part("y", f)))),
    )
    counted = hopeful.select("sig_x", "sig_y", "n_x", "n_y", total.alias("common"))
    joined = F.col("n_x") + F.col("n_y") - F.col("common")
    return counted.where(F.col("common") * DENOMINATOR >= joined * NUMERATOR).select("sig_x", "sig_y", (F.col("common") / joined).alias("similarity"))


class NearDuplicates:
    """Links between classes of equal sets, and the members of the classes."""

    def __init__(self, rows: DataFrame, key: str, text: str, *, pieces: int = FRAGMENTS, bits: int | None = None, part: int = setjoin.PART) -> None:
        """``rows``: equal rows count once; a null key or text is in no pair; extra columns aren't read."""
        wanted = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL").distinct()
        sets = materialize(setjoin.text_sets(wanted, ["key"], "text"), "neardup-sets")
        #: ``key, sig``: a row for each record with a run.
        self.members = sets.select("key", "sig")
        classes = materialize(setjoin.classes_of(sets, F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "neardup-classes")
        #: ``id, sig, rep, copies``: a row for each class; ``rep`` is its least key.
        self.classes = classes.select("id", "sig", "rep", "copies")
        order = setjoin.global_order(classes, bits, part)
        #: ``sig_x, sig_y, similarity``: every link between different classes once.
        self.links = materialize(links_of(materialize(cut(classes, order, pieces), "neardup-fragments"), order, pieces), "neardup-links")

    def pairs(self) -> DataFrame:
        """``key_a, key_b, similarity`` of every pair of records, copies included; ``key_a < key_b``."""
        a = self.members.select(F.col("key").alias("k1"), F.col("sig").alias("sig_x"))
        b = self.members.select(F.col("key").alias("k2"), F.col("sig").alias("sig_y"))
        between = spread(self.links).join(a, "sig_x").join(spread(b), "sig_y").select("k1", "k2", "similarity")
        many = self.classes.where("copies > 1").select("sig")
        copies = self.members.join(spread(many), "sig", "left_semi")
        within_ = spread(copies.select("sig", F.col("key").alias("k1"))).join(copies.select("sig", F.col("key").alias("k2")), "sig").where("k1 < k2").select("k1", "k2", F.lit(1.0).alias("similarity"))
        every = between.where("k1 <> k2").unionByName(within_)
        return every.groupBy(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """``key, group, copies, links``: one row a record.

        ``group`` is the least key that a chain of links joins it to, ``copies``
        the records with the same set, ``links`` the other classes that its own is
        linked to.
        """
        ids = self.classes.select("sig", "rep")
        edges = spread(self.links).join(ids.select(F.col("sig").alias("sig_x"), F.col("rep").alias("a")), "sig_x").join(spread(ids.select(F.col("sig").alias("sig_y"), F.col("rep").alias("b"))), "sig_y").select("a", "b")
        degree = edges.select(F.col("a").alias("rep")).unionAll(edges.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        roots = components(self.classes.select(F.col("rep").alias("v")), edges)
        of_class = self.classes.join(spread(roots.select(F.col("v").alias("rep"), F.col("root").alias("group"))), "rep").join(spread(degree), "rep", "left")
        return self.members.join(spread(of_class), "sig").select("key", "group", "copies", F.coalesce("links", F.lit(0)).alias("links"))
