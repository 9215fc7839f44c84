"""Tokens, packing and repetition."""

import os
import random

import pytest

from quillspan.llm import packing, repetition, tokens

from .helpers import plain

FOLDER = tokens.default_folder()
needs_files = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="the vocabulary isn't here")
ALPHABET = list("ab Z'sdltrevm  \n\t.,!19٣é的क्ิ_-’") + [" ", "​", "💩", "<|endoftext|>", "'ll", "'S"]
DOCS = [(1, "The tower fell.", 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (None, "x", 0), (6, "word " * 5000, 0), (7, "的" * 3000, 0), (8, "<|endoftext|>", 0), (1, "The tower fell.", 0)]


@needs_files
@pytest.mark.parametrize("leaf", [2, 3, 7, 40])
def test_tree_equals_plain_encoding(leaf):
    pick = random.Random(leaf)
    e = tokens.Encoder(FOLDER, leaf=leaf, window=2)
    for _ in range(1500):
        t = "".join(pick.choices(ALPHABET, k=pick.randrange(60)))
        ids = e.encode(t)
        assert ids == e.bpe.encode_ordinary(t) and e.decode(ids) == t


@needs_files
def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = tokens.Encoder(FOLDER, leaf=16)
    for _, text, _ in DOCS:
        assert e.encode(text) == (t.encode(text, add_special_tokens=False).ids if text else [])


@needs_files
def test_encoded_frame(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string, ids int")
    got = tokens.encode_documents(rows, "doc_id", "text", count="n").collect()
    e = tokens.encoder(FOLDER)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(k), e.encode(t)) for k, t, _ in DOCS)
    assert all(r["n"] == len(r["ids"]) for r in got)
    assert tokens.encode_documents(rows.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_histogram_packing(capacity):
    pick = random.Random(capacity)
    histogram = {n: pick.randrange(1, 40) for n in range(1, capacity + 1) if pick.random() < 0.6} or {1: 3}
    patterns = packing.pack_histogram(histogram, capacity)
    placed = {}
    for count, lengths in patterns:
        assert count > 0 and sum(n * k for n, k in lengths.items()) <= capacity
        for n, k in lengths.items():
            placed[n] = placed.get(n, 0) + count * k
    assert placed == histogram
    assert sum(c for c, _ in patterns) <= 2 * -(-sum(n * c for n, c in histogram.items()) // capacity)
    with pytest.raises(ValueError):
        packing.pack_histogram({capacity + 1: 1}, capacity)


@pytest.mark.parametrize("salts", [1, 5])
def test_packing(spark, salts):
    pick = random.Random(9)
    sizes = [(k, pick.choice([0, 1, 5, 17, 64, 65, 200, None, pick.randrange(1, 64)])) for k in range(300)]
    frame = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, n int, bin_id string")
    rows = packing.pack(frame, "doc_id", "n", [("small", 64), ("large", 1000)], salts).collect()
    for name, capacity in (("small", 64), ("large", 1000)):
        own = [r for r in rows if r["bin_name"] == name]
        filled, parts = {}, {}
        for r in own:
            filled[r["bin_id"]] = filled.get(r["bin_id"], 0) + r["piece_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["piece_start"], r["piece_tokens"], r["n_pieces"]))
        assert max(filled.values()) <= capacity and set(filled) == set(range(len(filled)))
        assert set(parts) == {k for k, _ in sizes}
        for k, n in sizes:
            cut = sorted(parts[k])
            assert sum(c[2] for c in cut) == (n or 0) and len(cut) == max(1, -(-(n or 0) // capacity)) == cut[0][3]
            assert [c[1] for c in cut] == [i * capacity for i in range(len(cut))]
        report = packing.fill_report(packing.pack(frame, "doc_id", "n", [(name, capacity)], salts), [(name, capacity)]).first()
        assert report["n_bins"] == len(filled) and report["least_bins"] <= report["n_bins"] <= 1.1 * report["least_bins"] + 1


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, n int")
    assert packing.pack(none, "doc_id", "n", [("a", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, "doc_id", "n", [])
    with pytest.raises(ValueError):
        packing.pack(none, "doc_id", "n", [("a", 0)])


def share(text):
    p = plain(text or "")
    windows = [p[i : i + 24] for i in range(len(p) - 23)]
    seen, again = set(), 0
    for w in windows:
        again += w in seen
        seen.add(w)
    return again, len(windows)


def repetitive_texts():
    pick = random.Random(8)
    words = ["harbour", "temple", "river", "zafo", "kirel", "old", "painted", "reservoir", "мост", "état"]
    sentence = lambda: " ".join(pick.choices(words, k=7)).capitalize() + f" {pick.randrange(10**6)}."
    out = [None, "", " ", "!!", "short", "x" * 500, "ＦＵＬＬ width " * 20, "line\n" * 80, "。".join(["同じ文がここにあるのです" * 3] * 4)]
    for _ in range(150):
        s = [sentence() for _ in range(pick.randrange(2, 12))]
        for _ in range(pick.randrange(8)):
            s.insert(pick.randrange(len(s)), pick.choice(s))
        out.append(pick.choice([" ", "\n", "\r\n\r\n"]).join(s))
    return out


def test_repetition(spark):
    rows = list(enumerate(repetitive_texts())) + [(None, "x" * 100)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, repeated_share double")
    got = repetition.repetition(frame, "doc_id", "text")
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == len(rows)
    for k, t in rows:
        assert (by[k]["repeated"], by[k]["windows"]) == share(t)
        assert 0 <= by[k]["content_share"] <= 1
    want = {k for k, t in rows if share(t)[1] and share(t)[0] >= 0.3 * share(t)[1]}
    assert {r["doc_id"] for r in repetition.repetitive(got).collect()} == want and len(want) > 20
    # counted for the documents only that the field doesn't retain, the result is the same
    some = repetition.repetition(frame, "doc_id", "text", every=False)
    assert {r["doc_id"] for r in repetition.repetitive(some).collect()} == want
    assert {r["doc_id"] for r in some.where("windows IS NULL").collect()} == {r["doc_id"] for r in got.where("retained").collect()}


def test_rare_repetition_is_found(spark):
    """No repeated line in the sample: those said again teach it."""
    pick = random.Random(4)
    plain_text = lambda: " ".join("".join(pick.choices("abcdefghijklmnop", k=pick.randrange(2, 9))) for _ in range(60)) + ".\n"
    rows = [(k, "".join(plain_text() for _ in range(4))) for k in range(300)]
    model = repetition.fit_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    one = plain_text()
    rows.append((999, one * 3))
    got = repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", model)
    assert [r["doc_id"] for r in repetition.repetitive(got).collect()] == [999]
    assert got.where("retained").count() >= 290


def test_repetition_of_nothing(spark):
    assert repetition.repetition(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
