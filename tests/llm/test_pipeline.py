"""Whole queries: the chunk table, the pipeline against brute force, differencing over cuts."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecframe.llm import html_text, toxicity, warc


def test_warc_round_trip_reads_the_chunk_table(spark, monkeypatch):
    tables = []
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **b: tables.append(read(*a, **b)) or tables[-1])
    big = "x" * (2 * warc.CHUNK + 5)
    out = warc.round_trip(spark.createDataFrame([(1, "u", big), (2, "v", "y")], "page_id long, url string, html string")).collect()
    chunks = tables[0].where("page_id = 1").orderBy("chunk").collect()
    assert len(chunks) > 1 and b"".join(c.data for c in chunks).decode() == big and [c["last"] for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in out}[1] == (len(big), chunks[-1].payload_digest) and len(out) == 2


def toxic_score(model, text):
    plain = 1.0
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"[^\W_]+", sentence)
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "*" for n in (3, 4, 5, 6, 7) if len(w) >= n)])
            plain *= 1 / (1 + np.exp(z))
    return 1 - plain


def grams(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def without_near_copies(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), (doc_id, i)), (doc_id, i))
    return [rows[i] for i in sorted(i for _, i in first.values())]


def without_repeats(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for j in range(len(data) - 199):
            window = data[j : j + 200]
            if window in seen:
                gone[j : j + 200] = b"\1" * 200
            seen.add(window)
        out.append((doc_id, bytes(c for c, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")))
    return out


def test_pipeline_equals_brute_force(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    inputs = []

    def keeping(stage):
        return lambda s, docs, d: inputs.append(docs) or stage(s, docs, d)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, keeping(f)) for n, f in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    first, no_toxic, no_copies, cut = ([(r.doc_id, r.text or "") for r in x.orderBy(F.monotonically_increasing_id()).collect()] for x in inputs)

    model = toxicity.train(inputs[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(no_toxic) == Counter(r for r in first if toxic_score(model, r[1]) < 0.7) and len(no_toxic) < len(first)
    assert Counter(no_copies) == Counter(without_near_copies(no_toxic)) and len(no_copies) < len(no_toxic)
    assert Counter(cut) == Counter(without_repeats(no_copies)) and Counter(cut) != Counter(no_copies)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in cut}
    assert len(ids) == len(cut)
    for i, p in pieces.groupby("doc_id"):  # every token of every document once
        p = p.sort_values("start")
        assert p.start.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() == len(ids[i])
        assert all(zlib.crc32(ids[i][a : a + n].tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32, strict=True))
    assert set(pieces.doc_id) == set(ids)
    for _, q in pieces.groupby("sequence_id"):
        q = q.sort_values("offset")
        total = int(q.length.sum())
        assert (q.length.cumsum() - q.length == q.offset).all() and total <= 2048 and (total == 2048 or total & (total - 1) == 0)


@pytest.mark.parametrize("size", [2, 9, 1000])
def test_html_differences_over_cuts_and_past_copies(spark, monkeypatch, size):
    page = lambda n: f"<div>Site name</div><p>Menu of all</p><p>text {n}</p>"
    rows = [(i, f"http://h/a/{i:02}", page(i // 4)) for i in range(24)] + [(90, "http://alone/x", page(1)), (91, None, page(2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "RANGE_PAGES", size)
    monkeypatch.setattr(html_text, "LEAST_PAGES", size)
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert out == {i: f"text {i // 4}" for i in range(24)} | {90: "Site name\nMenu of all\ntext 1", 91: "Site name\nMenu of all\ntext 2"}
