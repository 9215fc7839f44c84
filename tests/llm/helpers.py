"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import unicodedata


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(c)[0] in "LN")


def grams(text: str | None) -> set[str]:
    p = plain(text or "")
    return {p[i : i + 4] for i in range(len(p) - 3)}


def similar(a: set[str], b: set[str]) -> bool:
    return bool(a) and bool(b) and 5 * len(a & b) >= 3 * len(a | b)
