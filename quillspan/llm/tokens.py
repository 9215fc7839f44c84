"""Encoding a corpus with a public byte-level BPE (problem 8).

Method: monoid tree reduction. A text is halved until its parts are short, the
parts are encoded by themselves, and neighbours are joined by encoding a window
around their border again. The window grows until both its ends are cuts at
which no encoding of any text can have one token on both sides; the tokens
outside are then proven to be those of the whole text.

The proof: the vocabulary's pattern never puts into one piece

* a letter and a following non-letter,
* a number and a following non-number,
* another mark and a following blank or number, or, unless the mark is an
  apostrophe (which begins English endings such as 's), a following letter.

Whether a place is such a cut depends on its two neighbouring characters only,
and merges never cross pieces. See TOKENIZERS for the files; they are read from
the folder in ``folder`` and never copied.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabularies lie unless a call or QUILLSPAN_TOKENIZERS says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: The pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the longest part that is encoded in one piece: a leaf of the tree.
LEAF = 256
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_CUT = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


def default_folder() -> str:
    return os.environ.get("QUILLSPAN_TOKENIZERS", TOKENIZERS)


class Encoder:
    """Encodes texts; ``leaf`` is the length of the longest text encoded in one piece."""

    def __init__(self, folder: str, name: str = "byte_bpe_50k", leaf: int = LEAF, window: int = 64) -> None:
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.size = [len(b) for b in self.bytes_of]
        self.leaf, self.window = max(2, leaf), max(2, window)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; [] for null and for the empty text."""
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.bpe.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._tree(text, start, middle), self._tree(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its halves."""
        a, b = self._cut_before(text, start, middle), self._cut_after(text, middle, end)
        drop, k = len(text[a:middle].encode()), len(left)
        while drop > 0:
            k -= 1
            drop -= self.size[left[k]]
        drop, j = len(text[middle:b].encode()), 0
        while drop > 0:
            drop -= self.size[right[j]]
            j += 1
        return left[:k] + self.bpe.encode_ordinary(text[a:b]) + right[j:]

    def _cut_before(self, text: str, start: int, middle: int) -> int:
        """A cut before ``middle`` whose neighbours both lie in the left half, the last if the nearest blank gives none, else ``start``."""
        k = text.rfind(" ", max(start + 1, middle - self.window), middle)
        if k > 0 and text[k - 1] in _PLAIN:
            return k
        width = self.window
        while True:
            low = max(start, middle - width)
            last = None
            for m in _CUT.finditer(text, low + 1, middle):
                if m.start() < middle:  # at the middle itself the next character isn't seen
                    last = m.start()
            if last is not None:
                return last
            if low == start:
                return start
            width *= 2

    def _cut_after(self, text: str, middle: int, end: int) -> int:
        """A cut after ``middle`` whose neighbours both lie in the right half, the first if the nearest blank gives none, else ``end``."""
        k = text.find(" ", middle + 1, min(end, middle + self.window))
        if k > 0 and text[k - 1] in _PLAIN:
            return k
        m = _CUT.search(text, middle + 1, end)
        return m.start() if m else end

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes are joined up a tree of halves."""

        def join(i: int, j: int) -> bytes:
            if j - i <= 4096:
                return b"".join(self.bytes_of[k] for k in ids[i:j])
            return join(i, (i + j) // 2) + join((i + j) // 2, j)

        return join(0, len(ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=8)
def encoder(folder: str, name: str = "byte_bpe_50k", leaf: int = LEAF) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(folder, name, leaf)


def encode_documents(docs: DataFrame, key: str, text: str, *, ids: str | None = "ids", count: str | None = None, folder: str | None = None, name: str = "byte_bpe_50k", leaf: int = LEAF) -> DataFrame:
    """One row for each row of ``docs``: the key and its token ids and/or their number.

    Nulls and empty texts give an empty list and 0; blank texts are encoded as
    they are. The key may be null or repeated. Only key and text are read, so
    other columns of any name don't matter. No shuffle: one pass over the scan.
    """
    folder = folder or default_folder()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(key).schema.fields]
    fields += [f"`{ids}` array<int>"] * bool(ids) + [f"`{count}` int"] * bool(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name, leaf).encode
        for batch in batches:
            texts = batch.column(1)
            step = 512
            for i in range(0, batch.num_rows, step):
                part = [encode(t) for t in texts.slice(i, step).to_pylist()]
                columns = [batch.column(0).slice(i, step)]
                if ids:
                    columns.append(pa.array(part, type=pa.list_(pa.int32())))
                if count:
                    columns.append(pa.array(map(len, part), type=pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, *[ids] * bool(ids), *[count] * bool(count)])

    return docs.select(key, text).mapInArrow(run, ", ".join(fields))
