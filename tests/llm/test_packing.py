"""Packing against the tokenizer itself: every id once, in place, in sequences of the window."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vecframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = [
    None, "", " \t\n", "a<|endoftext|>b <|endoftext|>", "é ﬁ ▁ x\x1cy  z　w", "I'll don't ' 'Tis 'LL x'sx abc'''s", "x<|b ab|> a<b a|b a<|", "İ ẞ ß ÀÉ. Straße! a×b ÷", "\x1c b c",
    "ab\n\ncd\x0b\x0cq\x85r", "a\x00b c\x7f d", "12 3.5e4 ª µ ²", "é a x ́b", "word " * 9000, "日本語" * 700, "x" * 5000,
]


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(pieces, rows):
    """``rows``: texts by doc_id, each once; the pieces tile every document and fill sequences without gaps."""
    assert set(pieces.column("doc_id").to_pylist()) == set(rows)
    at = {}
    for r in pieces.to_pylist():
        at.setdefault(r["doc_id"], []).append(r)
    for doc_id, own in at.items():
        ids, place = ids_of(rows[doc_id]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == place and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[place : place + r["length"]].tobytes())
            place += r["length"]
        assert place == len(ids)
    sequences = {}
    for r in pieces.to_pylist():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 2048 and not place & (place - 1)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_pieces_tile_documents(spark, n):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = (ODD if n else []) + [" ".join(rng.choice(words) + rng.choice(["", ".", "%%%"]) for _ in range(int(rng.lognormvariate(5, 1.2)))) for _ in range(n)]
    rows = {(1 << 53) + 1 + 2 * i: t for i, t in enumerate(texts)}  # ids that doubles cannot hold
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows.items()], "doc_id long, text string, rest int, uid string").repartition(5)
    check(packing.pack(docs, PATH).toArrow(), rows)


def test_large_ids_beside_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    ids = [(1 << 60) + i if i % 10 else None for i in range(2000)]
    docs = spark.createDataFrame([(i, f"text {k} of {k % 7}") for k, i in enumerate(ids)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH).toArrow().to_pylist()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(ids)
    assert sum(r["length"] for r in pieces) == sum(len(ids_of(f"text {k} of {k % 7}")) for k in range(2000))
    twice = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in packing.pack(twice, PATH).where("start = 0").collect()] == [(1, 0), (1, 0)]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 3)
    words = packing.WordIds(PATH)
    for text in [*ODD[:-3], *ODD]:
        assert next(words.encode(pa.array([text or ""]))).tolist() == ids_of(text).tolist()


def test_ids_of_random_texts():
    rng = random.Random(11)
    parts = [*"abcXYZ'0123!?$#<|>.,-_ßÀÉéöÿ÷×µªº́ijİıſ…—中あ🙂 \n\t\r  \x0b\x1c\x00", "'s", "'re", "<|startoftext|>", "<|", "|>", "</w>", "'LL", "ﬁ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(5000)]
    for text, ids in zip(texts, packing.WordIds(PATH).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == ids_of(text).tolist()


def test_plan():
    have = np.zeros(2048, np.int64)
    have[[100, 700, 1248, 800, 1024]] = [50, 50, 80, 30, 9]
    used = Counter()
    for lengths, n in packing.plan(have):
        assert sum(lengths) == 2048
        for v in lengths:
            used[v] += n
    assert all(used[v] <= have[v] for v in used) and used[1248] == 80
    columns = packing.combinations(have).tolist()
    assert sorted(map(tuple, columns)) == [(100, 700, 1248), (800, 1248, 0), (1024, 1024, 0)]
    few = np.zeros(2048, np.int64)
    few[1100] = 5  # two do not fit one window
    assert packing.plan(few) == []
    counts = packing.repeat_counts(packing.combinations(have), have)
    left = have.astype(float)
    for (a, b, c), x in zip(columns, counts, strict=True):
        assert x >= 0
        left[a] -= x
        left[b] -= x
        left[c] -= x * (c > 0)
    # The least squares leave a gradient that is zero where a count is positive, and none uphill.
    gain = np.array([left[a] + left[b] + left[c] * (c > 0) for a, b, c in columns])
    assert (gain < 1.5).all() and (abs(gain[counts > 1]) < 1.5).all()
