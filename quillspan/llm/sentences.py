"""Sentence boundaries across languages and scripts (problem 2).

Method: a linear chain tags characters as boundary (the last of a sentence) or
inside, and Viterbi decoding finds the best tagging. Only some characters can be
tagged as boundary: the end of a cluster of closing marks with the quotes and
brackets that close there, and, in scripts that part sentences by blanks, the
character before a blank. All others are inside by construction, so the chain
runs over these places. A line break always ends a sentence.

Training needs no labels from outside: in texts that stand one sentence a line,
the line ends are the boundaries. Their lines are joined again with blanks, or
with nothing, so that the chain sees the boundaries without the breaks; in
scripts that part sentences by blanks all stops are stripped first.

Text without any marks, in scripts that write no blanks either, has a second chain
that tags every character: it learns from sentences of these scripts whose closing
marks are stripped, and decodes stretches of BARE letters or more without a mark.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.chain import Chain, fit

#: Texts that the chain is fitted on, at most; the least number of lines that a text of one sentence a line has.
SAMPLE, LINES = 4000, 3
#: Longest line of such a text, in characters.
LONGEST = 400
#: Letters in a row without a mark from which a text without blanks counts as unpunctuated; sentences that its chain is fitted on, at most.
BARE, BARE_SAMPLE = 60, 3000
#: Characters of a text that the chains are fitted on, at most.
STRETCH = 20_000
BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
_BREAK = re.compile(f"[{BREAKS}]+")
#: Marks that can end a sentence (fixed values).
STOPS = ".!?…。！？｡।॥؟۔።։"
#: Opening marks and what closes them (fixed values); straight marks close themselves.
OPENERS = {"“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "»": "«", '"': '"'}
CLOSERS = set("”“»’」』）)]】》\"")
PAREN = set("）)]】")
#: Scripts whose sentences are parted by blanks: Thai, Lao, Khmer, Burmese (fixed values).
UNSTOPPED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: Scripts that write sentences without blanks between them: kana and Han (fixed values).
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_EVENT = re.compile("[" + re.escape(STOPS + "".join(OPENERS) + "".join(sorted(CLOSERS))) + f"{BREAKS}]|(?<={UNSTOPPED.pattern})\\s+|\\s+(?={UNSTOPPED.pattern})")
_WORD = re.compile(r"[^\s“”„«»\"‘’「」（）()\[\]¿¡,;:，、：!?…。！？｡।॥؟۔]+$")
_AHEAD = re.compile(r"[^\s(«“„\".!?。！？।]+\.?(?=[\s\u00a0]*$)")
_NEXT = re.compile(r"\w[\w'’-]*")
_CLAUSE = re.compile(f"[^{re.escape(STOPS)},，、;；:：{BREAKS}“„«「]*")
_STOP = re.compile(f"[{re.escape(STOPS)}]+")
#: Letters in a row of scripts without blanks, and their sentences with closing marks (fixed values).
_BARE = re.compile(f"(?:{UNSPACED.pattern}|[\u3005\u3006\u3007\u30fc0-9A-Za-z]){{{BARE},}}")
_CLOSED = re.compile(f"((?:{UNSPACED.pattern}|[\u3005\u3006\u3007\u30fc、，0-9A-Za-z]){{4,}})[。！？｡]+(?![」』）”])")
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"


def _blank(c: str) -> bool:
    return c.isspace() or c in _INVISIBLE


def _kind(text: str, i: int) -> str:
    if i >= len(text):
        return "end"
    c = text[i]
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    if UNSPACED.match(c):
        return "han"
    if c.isalpha():
        return "letter"
    if c in OPENERS or c in "¿¡":
        return "open"
    if c in ",;:，、；：":
        return "comma"
    if c in "-–—":
        return "dash"
    return "mark"


def places(text: str) -> list[tuple[int, list[str] | None]]:
    """The places of ``text`` that can be boundaries, as offsets after the character, with their features; None where a line break makes it one."""
    out: list[tuple[int, list[str] | None]] = []
    stack: list[tuple[str, str, bool]] = []  # what closes it, what stands before the opener, whether it opens a sentence
    done = 0
    size = len(text)
    line = 0  # where the line, or the sentence for what is known, starts
    for m in _EVENT.finditer(text):
        i = m.start()
        if i < done:
            continue
        c = text[i]
        if c in BREAKS:
            end = i
            while end > line and _blank(text[end - 1]):
                end -= 1
            out.append((end, None))
            stack.clear()
            done = line = m.end()
            continue
        if c.isspace():
            if out and out[-1][0] == i:
                continue  # a closing mark stands before the blank
            before, after = text[i - 1] if i else "", text[m.end()] if m.end() < size else ""
            if not before or not after or after in BREAKS:
                continue
            touch = before.isdigit() or after.isdigit()
            own = bool(UNSTOPPED.match(before)), bool(UNSTOPPED.match(after))
            out.append((i, ["blank", f"blank touch {touch}", f"blank {own} {touch}", f"blank inside {bool(stack)} {touch}"]))
            continue
        if c not in STOPS:
            if stack and c == stack[-1][0]:
                stack.pop()
                continue
            if c in OPENERS and not (c in "\"“»" and stack and any(s[0] == c for s in stack)):
                k = i - 1
                while k >= 0 and text[k] in " \u00a0\t\u3000":
                    k -= 1
                lead = "start" if k < line or text[k] in STOPS or text[k] in CLOSERS else "colon" if text[k] in ",:，：、" else "word"
                stack.append((OPENERS[c], lead, lead == "start"))
            elif stack and any(s[0] == c for s in stack):
                while stack.pop()[0] != c:
                    pass
            continue
        # a cluster of stops and of what closes there
        j = i
        while j < size and text[j] in STOPS:
            j += 1
        stops = text[i:j]
        closed = ""
        lead = ""
        while j < size:
            k = j
            while k < size and text[k] in " \u00a0\u202f":
                k += 1
            if k < size and text[k] in CLOSERS and stack and any(s[0] == text[k] for s in stack) and (k == j or text[k] == "»"):
                while True:
                    close, lead, _ = stack.pop()
                    if close == text[k]:
                        break
                closed = text[k]
                j = k + 1
            elif k == j and text[j] in STOPS and closed:
                j += 1
            elif k == j and text[j] in "”’」』）)]】" :
                j += 1  # closes what was never opened
            else:
                break
        done = j
        k = j
        while k < size and _blank(text[k]) and text[k] not in BREAKS:
            k += 1
        gap = k > j
        kind = "break" if k < size and text[k] in BREAKS else _kind(text, k)
        word = _WORD.search(text, max(line, i - 24), i)
        word = word[0] if word else ""
        how = "none" if not closed else "paren" if closed in PAREN else "quote"
        stop = stops if len(stops) <= 3 else stops[:3]
        depth = "paren" if stack and stack[-1][0] in PAREN else "quote" if stack else "no"
        if len(word) > 3 and "." not in word:
            word = word.lower()
        short = word if len(word) <= 6 or "." in word else ""
        shape = "digits" if word.replace(",", "").replace(".", "").isdigit() else "letter" if len(word) == 1 else "dotted" if "." in word else "short" if len(word) <= 3 else "long" if word else "empty"
        features = [
            "stop", f"stop {stop}", f"gap {gap} {kind} {stop[0]}", f"depth {depth}", f"closed {how} {lead} {kind}",
            f"shape {shape} {kind} {gap}", f"{stop} {how} {kind}",
        ]
        if stop[0] == ".":
            if len(short) <= 4 or "." in short:
                ahead = _AHEAD.search(text, max(line, i - len(word) - 16), i - len(word))
                ahead = ahead[0] if ahead else ""
                features.append(f"ahead {ahead[-8:]} {shape if shape == 'digits' else short}")
            features.append(f"word {short or '-'}")
            features.append(f"word {short or '-'} {kind}")
            if gap and kind in ("upper", "lower", "letter", "digit"):
                following = _NEXT.match(text, k)
                if following:
                    features.append(f"next {following[0][:12].lower()}")
                    if short:
                        features.append(f"word {short} next {following[0][:12].lower()}")
        if how == "quote":
            clause = _CLAUSE.match(text, k)[0].strip()
            words = clause.split()
            features.append(f"said {words[-1] if len(words) > 1 else clause[-2:]}")
            features.append(f"first {words[0].lower() if words and len(words[0]) < 12 else ''}")
            features.append(f"lead {lead} {stop}")
        out.append((j, features))
    return out


def _training(texts: list[str], seed: int = 7) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Sequences and tags from texts of one sentence a line, joined again."""
    pick = random.Random(seed)
    sequences, tags = [], []
    for text in texts:
        lines = [s for s in (x.strip() for x in _BREAK.split(text)) if s and any(c.isalnum() for c in s)]
        if len(lines) < LINES or max(map(len, lines)) > LONGEST:
            continue
        # a line without a closing mark is a heading: nothing but the break ends it
        parts, ends, at = [], set(), 0
        for n, s in enumerate(lines):
            if UNSTOPPED.search(s):
                s = _STOP.sub("", s).strip()
            if not s:
                continue
            ended = s[-1] in STOPS or s[-1] in CLOSERS or bool(UNSTOPPED.search(s))
            if not ended:
                if n + 1 < len(lines):
                    continue
            unspaced, unstopped = bool(UNSPACED.search(s[-3:])), bool(UNSTOPPED.search(s))
            join = "" if n + 1 == len(lines) else " " if unstopped else pick.choice(["", "", "", " "]) if unspaced else pick.choice([" ", " ", "  ", " ", ""])
            at += len(s)
            ends.add(at)
            at += len(join)
            parts.append(s + join)
        joined = "".join(parts)
        found = places(joined)
        if found:
            sequences.append([f or [] for _, f in found])
            tags.append([int(i in ends) for i, f in found])
    return sequences, tags


@dataclass
class Model:
    """The chain over closing marks and blanks, and the one over the characters of unpunctuated text."""

    marks: Chain
    bare: Chain = field(default_factory=Chain)


def _around(text: str, i: int) -> list[str]:
    """What surrounds the place after character ``i`` of unpunctuated text."""
    a, b, c, d = text[i - 1 : i], text[i], text[i + 1 : i + 2], text[i + 2 : i + 3]
    return ["always", f"b {b}", f"ab {a}{b}", f"c {c}", f"cd {c}{d}", f"bc {b}{c}", f"kind {_kind(text, i)} {_kind(text, i + 1)}"]


def _stripped(texts: list[str], most: int, seed: int = 11) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Sentences of scripts without blanks, their marks stripped, joined to sequences; the last character of each is a boundary."""
    known = sorted({m[1].replace("、", "").replace("，", "") for t in texts for m in _CLOSED.finditer(t)})
    pick = random.Random(seed)
    pick.shuffle(known)
    sequences, tags = [], []
    for i in range(0, min(len(known), most), 8):
        joined = "".join(known[i : i + 8])
        ends = set(np.cumsum([len(x) for x in known[i : i + 8]]).tolist())
        sequences.append([_around(joined, k) for k in range(len(joined))])
        tags.append([int(k + 1 in ends) for k in range(len(joined))])
    return sequences, tags


def fit_boundaries(texts: DataFrame, text: str, sample: int = SAMPLE) -> Model:
    """Fit the chains on at most ``sample`` texts each: for marks those that have LINES lines or more, for unpunctuated text those of its scripts; those with the lowest hashes.

    One scan. A longer text gives a stretch of STRETCH characters at a drawn place.
    """
    lined = F.size(F.split(F.col(text), f"[{BREAKS}]+")) >= LINES
    unspaced = F.col(text).rlike(UNSPACED.pattern)
    h = F.xxhash64(text)
    n = texts.count()
    few = int(min(1.0, 16.0 * sample / max(n, 1)) * (1 << 20))  # bounds what a partition sends
    start = F.pmod(h, F.greatest(F.lit(1), F.length(text) - STRETCH + 1)) + 1
    found = texts.where(F.pmod(h, F.lit(1 << 20)) < few).select(F.substring(F.col(text), start.cast("int"), F.lit(STRETCH)).alias("_t"), h.alias("_h"), F.explode(F.array_compact(F.array(F.when(lined, "lines"), F.when(unspaced, "bare")))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("_h"))
    rows = found.withColumn("_r", rank).where(F.col("_r") <= sample).select("_k", "_t").orderBy("_k", "_r").collect()
    of = lambda k: [r["_t"] for r in rows if r["_k"] == k]
    return Model(fit(*_training(of("lines")), rounds=150, penalty=0.3), fit(*_stripped(of("bare"), BARE_SAMPLE), rounds=60, penalty=0.3, least=2))


def _parted(text: str, chain: Chain) -> list[int]:
    """Boundaries inside the unpunctuated stretches of a text."""
    out = []
    for m in _BARE.finditer(text):
        tags = chain.tag([_around(m[0], k) for k in range(len(m[0]))])
        out += [m.start() + k + 1 for k, tag in enumerate(tags[:-1]) if tag]
    return out


def sentences_of(text: str | None, model: Model) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end) in code points, in order.

    A sentence holds a letter or digit. Marks that stand alone after a sentence of
    the same line belong to it. Null, blank and mark-only texts have none.
    """
    if not text:
        return []
    found = places(text)
    ends: list[tuple[int, bool]] = []
    run: list[tuple[int, list[str]]] = []

    def decode() -> None:
        tags = model.marks.tag([f for _, f in run])
        ends.extend((i, False) for (i, _), tag in zip(run, tags) if tag)
        run.clear()

    for i, features in found:
        if features is None:
            decode()
            ends.append((i, True))
        else:
            run.append((i, features))
    decode()
    if model.bare.weight:
        parted = _parted(text, model.bare)
        if parted:
            ends = sorted([*ends, *((i, False) for i in parted)])
    ends.append((len(text), True))
    out: list[tuple[int, int]] = []
    start, fresh = 0, True  # fresh: no sentence of this line yet
    for end, hard in ends:
        a, b = start, max(start, end)
        while a < b and _blank(text[a]):
            a += 1
        while b > a and _blank(text[b - 1]):
            b -= 1
        if any(c.isalnum() for c in text[a:b]):
            out.append((a, b))
            fresh = False
        elif b > a and not fresh:
            out[-1] = (out[-1][0], b)
        start = max(start, end)
        fresh = fresh or hard
    return out


def sentences(texts: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """The key, ``sent_idx`` from 0, ``sent_start``, ``sent_end`` and ``sentence``: a row for each sentence of each row's text.

    Offsets count code points; a sentence runs through its last closing mark,
    quote or bracket. Texts without letters and digits give no row. The key may be
    null; rows aren't compared with each other. One pass, no shuffle.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model or fit_boundaries(texts, text))
    kind = texts.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows, number, starts, ends, spans = [], [], [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    for n, (a, b) in enumerate(sentences_of(t, known)):
                        rows.append(k)
                        number.append(n)
                        starts.append(a)
                        ends.append(b)
                        spans.append(t[a:b])
                at = pa.array(rows, type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *[pa.array(x, type=pa.int32()) for x in (number, starts, ends)], pa.array(spans, type=pa.string())], names=[key, "sent_idx", "sent_start", "sent_end", "sentence"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, sent_idx int, sent_start int, sent_end int, sentence string")
