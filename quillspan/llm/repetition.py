"""Repetition inside a single document (problem 10).

Method: line sequence labelling. A document is a sequence of lines (long lines
are parted at sentence ends); a linear-chain conditional random field marks each
as content or boilerplate by Viterbi decoding, and the share of content decides
whether the document is retained.

The field sees cheap evidence of each line: how many of its short runs of letters
and digits stood earlier in the document, its length, digits and place. It is
fitted on a bounded sample whose labels come from the exact measure, which the
evidence doesn't hold: a window of ``width`` consecutive characters (NFKC, lower
case, letters and digits only) is repeated if it equals an earlier one of the
same text, and a line is boilerplate if at least LINE_SHARE of the windows that
start in it are. Every document of the sample is taken once more with some of its
lines said again, so that repeated lines are learned however rare they are.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.chain import Chain, fit
from quillspan.llm.chars import _kept, mix, runs
from quillspan.llm.setjoin import pieces

#: Characters of a window, the share of repeated windows from which a text counts as repetition, and that of a boilerplate line.
WIDTH, SHARE, LINE_SHARE = 24, 0.3, 0.1
#: Characters of the short runs that the field sees, and of the least stretch in which it looks for them.
SHORT, AHEAD = 8, 32
#: A document is retained if at least this share of its characters is content.
KEEP = 0.99
#: Documents that the field is fitted on, at most, and characters of each, at most.
SAMPLE, LONGEST = 2000, 20_000
_BREAKS, _STOPS, _FULL_STOPS, _BLANKS = "\n\r\v\f\x1c\x1d\x1e\x85  ", ".!?", "。！？।؟", " \t 　"
#: Bounds of the bins of a line's share of short runs seen earlier, and of the share of digits.
_SEEN, _DIGITS = np.array([1e-9, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.999]), np.array([1e-9, 0.25, 0.6])
_COLUMNS = ("seen", "long", "digits", "place", "both")


def _flags() -> np.ndarray:
    """For each code point: 1 letter or digit, 2 line break, 4 stop, 8 full stop of a script without blanks, 16 blank, 32 ASCII digit."""
    out = _kept().astype(np.uint8)
    for flag, chars in ((2, _BREAKS), (4, _STOPS), (8, _FULL_STOPS), (16, _BLANKS), (32, "0123456789")):
        out[[ord(c) for c in chars]] |= flag
    return out


_held: list[np.ndarray] = []


def _again(hashes: np.ndarray) -> np.ndarray:
    """Does each value stand at an earlier place too?"""
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
    out = np.ones(len(hashes), dtype=bool)
    if len(first):
        out[np.minimum.reduceat(order, first)] = False
    return out


class Measured:
    """Texts in arrays: their characters, their lines and what of them is repeated."""

    def __init__(self, texts: list[str | None]) -> None:
        if not _held:
            _held.append(_flags())
        lowered = [unicodedata.normalize("NFKC", t).lower() if t else "" for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        flags = _held[0][points]
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)))
        new = flags & (2 | 8) > 0
        new[:-1] |= (flags[:-1] & 4 > 0) & (flags[1:] & 16 > 0)
        kept = flags & 1 > 0
        self.texts, self.points, self.doc = len(texts), points[kept], doc[kept]
        line = np.cumsum(new)[kept]
        self.starts = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])]) if len(line) else np.zeros(0, dtype=np.int64)
        #: The text and the characters of each line.
        self.line_doc = self.doc[self.starts]
        self.chars = np.diff(np.r_[self.starts, len(line)])
        digits = np.r_[0, np.cumsum(flags[kept] & 32 > 0)]
        ends = self.starts + self.chars
        self.digits = digits[ends] - digits[self.starts]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each character: does a window start there, and is it repeated?"""
        n = len(self.points)
        inside, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        hashed = runs(self.points, width)
        if len(hashed):
            inside[: len(hashed)] = self.doc[: len(hashed)] == self.doc[width - 1 :]
            at = np.flatnonzero(inside)
            again[at] = _again(hashed[at] ^ mix(self.doc[at]))
        return inside, again

    def by_line(self, flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[self.starts + self.chars] - total[self.starts]

    def by_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[flags], minlength=self.texts)

    def evidence(self) -> np.ndarray:
        """A row of small numbers for each line, a column for each of _COLUMNS."""
        inside, again = self.windows(SHORT)
        # a short line is seen with what follows it
        until = np.minimum(np.maximum(self.starts + self.chars, self.starts + AHEAD), np.searchsorted(self.doc, self.line_doc, side="right"))
        n, seen = (np.r_[0, np.cumsum(f)][until] - np.r_[0, np.cumsum(f)][self.starts] for f in (inside, again))
        share = np.where(n > 0, np.searchsorted(_SEEN, seen / np.maximum(n, 1), side="right"), len(_SEEN) + 1)
        long = np.minimum(9, np.log2(np.minimum(self.chars, 400)).astype(np.int64) + 1)
        first = np.r_[True, self.line_doc[1:] != self.line_doc[:-1]] if len(n) else np.zeros(0, dtype=bool)
        last = np.r_[first[1:], True] if len(n) else first
        digits = np.searchsorted(_DIGITS, self.digits / np.maximum(self.chars, 1), side="right")
        return np.stack([share, long, digits, first + 2 * last, share * 16 + long], axis=1) if len(n) else np.zeros((0, len(_COLUMNS)), dtype=np.int64)

    def labels(self, width: int) -> np.ndarray:
        """1 for a line of which at least LINE_SHARE of the windows are repeated, by exact count."""
        inside, again = self.windows(width)
        n = self.by_line(inside)
        return ((n > 0) & (self.by_line(again) >= LINE_SHARE * n)).astype(np.int64)


class Field:
    """The fitted chain as tables, one for each column of evidence."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.bias = chain.weight.get("always", 0.0)
        self.tables = [np.zeros(256) for _ in _COLUMNS]
        for name, w in chain.weight.items():
            column, _, value = name.partition(" ")
            if column in _COLUMNS:
                self.tables[_COLUMNS.index(column)][int(value)] = w

    def tag(self, m: Measured) -> np.ndarray:
        """The tags of all lines: 1 is boilerplate."""
        rows = m.evidence()
        scores = (self.bias + sum(t[rows[:, k]] for k, t in enumerate(self.tables))).tolist() if len(rows) else []
        starts = np.flatnonzero(np.r_[True, m.line_doc[1:] != m.line_doc[:-1]]).tolist() if len(rows) else []
        out: list[int] = []
        for i, j in zip(starts, [*starts[1:], len(rows)]):
            out += self.chain.viterbi(scores[i:j])
        return np.array(out, dtype=np.int64)


def _said_again(text: str, pick: random.Random) -> str:
    """The text with some of its lines (or sentences) said again at other places, or a piece of one many times."""
    parts = [p for p in re.split(r"(?<=[\n。！？])|(?<=[.!?])(?=\s)", text) if p]
    if pick.random() < 0.2:
        parts.append(f"{pick.choice(parts).strip()[: pick.randrange(8, 60)]} " * pick.randrange(2, 60))
    for _ in range(pick.randrange(1, 2 + len(parts) // 2)):
        parts.insert(pick.randrange(len(parts) + 1), pick.choice(parts) + pick.choice(["", "\n"]))
    return "".join(parts)


def fit_lines(docs: DataFrame, key: str, text: str, sample: int = SAMPLE, width: int = WIDTH, longest: int = LONGEST) -> Field:
    """Fit the field on at most ``sample`` documents, those whose key has the lowest hash, and on as many with lines said again. A longer document gives a stretch of ``longest`` characters at a drawn place."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    few = int(min(1.0, 4.0 * sample / max(docs.count(), 1)) * (1 << 30))  # about four times the sample, so that no partition sends a whole one
    start = F.pmod(F.xxhash64(key, F.lit("start")), F.greatest(F.lit(1), F.length(text) - longest + 1)) + 1
    rows = docs.where((h < few) & (F.length(text) > 0)).select(h.alias("_h"), key, F.substring(F.col(text), start, F.lit(longest)).alias("_t")).orderBy("_h", key, "_t").limit(sample).select("_t").collect()
    pick = random.Random(10)
    features, labels = [], []
    for texts in ([r["_t"] for r in rows], [_said_again(r["_t"], pick) for r in rows]):
        for i in range(0, len(texts), 64):
            m = Measured(texts[i : i + 64])
            evidence, tags = m.evidence().tolist(), m.labels(width).tolist()
            for k in np.unique(m.line_doc).tolist():
                a, b = np.searchsorted(m.line_doc, [k, k + 1])
                features.append([["always", *[f"{c} {v}" for c, v in zip(_COLUMNS, line)]] for line in evidence[a:b]])
                labels.append(tags[a:b])
    return Field(fit(features, labels, rounds=60, penalty=0.1))


def repetition(docs: DataFrame, key: str, text: str, model: Field | None = None, width: int = WIDTH, keep: float = KEEP, every: bool = True) -> DataFrame:
    """One row a document: ``lines, boilerplate_lines, content_share, retained, windows, repeated, repeated_share``.

    ``content_share`` is the share of the characters that lie in lines marked as
    content, ``retained`` says whether it is at least ``keep``; ``repeated_share``
    is the exact share of repeated windows, which is counted for all documents, or,
    without ``every``, for those that aren't retained only (null for the others).
    Null, empty and blank texts and texts shorter than a window have no windows:
    shares are 1 for content and 0 for repetition. Keys may be null or repeated;
    columns other than key and text aren't read. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit_lines(docs, key, text, width=width))  # some hundred weights
    names = ["lines", "boilerplate_lines", "content_share", "retained", "windows", "repeated", "repeated_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for part in pieces(batches, 1, 1 << 19, 512):
            texts = part.column(1).to_pylist()
            m = Measured(texts)
            tags = field.tag(m)
            per = lambda w: np.bincount(m.line_doc, weights=w, minlength=len(texts))
            chars = per(m.chars)
            share = np.where(chars > 0, 1 - per(m.chars * tags) / np.maximum(chars, 1), 1.0)
            retained = share >= keep
            asked = np.arange(len(texts)) if every else np.flatnonzero(~retained)
            exact = m if every else Measured([texts[k] for k in asked])
            inside, again = exact.windows(width)
            windows, repeated = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            windows[asked], repeated[asked] = exact.by_text(inside), exact.by_text(again)
            unknown = np.ones(len(texts), dtype=bool)
            unknown[asked] = False
            columns = [pa.array(per(None).astype(np.int32)), pa.array(per(tags).astype(np.int32)), pa.array(share), pa.array(retained), pa.array(windows, mask=unknown), pa.array(repeated, mask=unknown), pa.array(repeated / np.maximum(windows, 1), mask=unknown)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, *names])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lines int, boilerplate_lines int, content_share double, retained boolean, windows long, repeated long, repeated_share double")


def repetitive(measured: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that their share of content doesn't retain and of which, exactly counted, ``share`` of the windows are repeated."""
    return measured.where(~F.col("retained") & (F.col("windows") > 0) & (F.col("repeated") >= F.lit(share) * F.col("windows") - 1e-9))
