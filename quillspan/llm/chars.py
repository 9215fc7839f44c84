"""Texts as arrays of code points: NFKC, lower case, letters and digits only."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """For each code point: is it a letter or a number (Unicode L, N)?"""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), dtype=bool, count=0x110000)


def plain(text: str) -> np.ndarray:
    """Code points of ``text`` after NFKC and lower case, without all that is no letter or digit."""
    lowered = unicodedata.normalize("NFKC", text).lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points[_kept()[points]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (splitmix64)."""
    x = x.astype(np.uint64) + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def runs(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive code points, one for each start.

    Hashes of runs of 1, 2, 4, ... characters are built from the halves, and
    those of n from the powers of two that make it up.
    """
    if len(points) < n:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, width = None, 0, mix(points), 1
    base = np.uint64(0x9E3779B97F4A7C15)
    while True:
        if n & width:
            if out is None:
                out, done = power, width
            else:
                size = len(points) - done - width + 1
                out = mix(out[:size] * base + power[done : done + size])
                done += width
        if done == n:
            return out
        power = mix(power[:-width] * base + power[width:])
        width *= 2


def run_sets(texts: list[str | None], n: int, salts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, grams)``: for each text the different hashes of its runs, ascending, one text after another.

    ``salts``, a number a text, keep the sets of different numbers apart.
    """
    lowered = [unicodedata.normalize("NFKC", t).lower() if t else "" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = _kept()[points]
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)))[kept]
    hashed = runs(points[kept], n)
    if not len(hashed):
        return np.zeros(len(texts), dtype=np.int64), hashed
    inside = row[: len(hashed)] == row[n - 1 :]  # a run doesn't cross texts
    hashed, row = hashed[inside], row[: len(hashed)][inside]
    if salts is not None:
        hashed = hashed ^ salts[row]
    order = np.argsort(hashed)
    order = order[np.argsort(row[order].astype(np.uint16) if len(texts) <= 1 << 16 else row[order], kind="stable")]
    hashed, row = hashed[order], row[order]
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])] if len(hashed) else np.zeros(0, dtype=bool)
    return np.bincount(row[new], minlength=len(texts)), hashed[new]
