"""Longest previous factors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from vecframe.llm import suffix_dedup as sd


def common(b, i, j):
    k = 0
    while k < sd.WIDTH and b[i + k] == b[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("trial", range(6))
def test_longest_factors(trial):
    rng = np.random.default_rng(trial)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    if trial % 2:
        text[260:480] = text[:220]
    if trial == 4:
        text[:] = np.resize(np.frombuffer(b"abcab", np.uint8), 500)
    starts = np.arange(301)
    ranks, whole = sd.suffix_ranks(text, starts)
    order = np.argsort(whole, kind="stable")
    b = text.tobytes()
    assert [b[i : i + 200] for i in order] == sorted(b[i : i + 200] for i in starts)
    prefixes = sd.common_prefixes(text, ranks, whole[order], order)
    assert prefixes.tolist() == [0, *(common(b, i, j) for i, j in zip(order, order[1:], strict=False))]
    previous, later = sd.longest_factors(order, prefixes), sd.longest_factors(order, prefixes, later=True)
    for r in range(0, 301, 5):
        i = order[r]
        assert previous[r] == max((common(b, i, j) for j in range(i)), default=0)
        assert later[r] == max((common(b, i, j) for j in range(i + 1, 301)), default=0)


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeated_windows(keep_first):
    rng = np.random.default_rng(3)
    base = [bytes(rng.integers(97, 101, 260).astype(np.uint8)) for _ in range(6)]
    parts = [*base, base[0][20:] + b"x" * 20, base[1][:230], b"ab" * 150, base[2][:100] + base[3][:150]]
    counts = [1, 1, 3, 1, 1, 2, 1, 1, 1, 1]
    copies = [p for p, c in zip(parts, counts, strict=True) if c > 1]
    seen = [p[j : j + 200] for p in [*parts, *copies] for j in range(len(p) - 199)]
    for k, (part, found) in enumerate(zip(parts, sd.repeated_windows(parts, counts, keep_first), strict=True)):
        before = {p[j : j + 200] for p in parts[:k] for j in range(len(p) - 199)}
        want = []
        for j in range(len(part) - 199):
            w = part[j : j + 200]
            want += [j] if (w in before or w in {part[i : i + 200] for i in range(j)} if keep_first else seen.count(w) > 1) else []
        assert found.tolist() == want


def test_polynomials_do_not_decide(spark):
    """Thue-Morse words and their complement, whose polynomial hashes agree modulo 2**64 for every odd base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, "x" + word[:1024] + "y"), (4, "z" + other[:1024] + "w")], "doc_id long, text string")
    from vecframe.llm import near_join

    assert {(r.doc_id, r.component_id) for r in near_join.jaccard_components(docs).collect()} == {(i, i) for i in (1, 2, 3, 4)}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    windows = [t[j : j + 200] for t in texts.values() for j in range(len(t) - 199)]
    for r in sd.repeated_bytes(docs).collect():
        t, gone = texts[r.doc_id], set()
        for j in range(len(t) - 199):
            if windows.count(t[j : j + 200]) > 1:
                gone.update(range(j, j + 200))
        assert r.n_removed == len(gone)
