"""Edge cases: empty tables, clashing columns, long texts, ties and SQL of whole queries."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vecframe.llm import common, fingerprints, html_text, lattice_lsh, near_join, oracles, packing, piece_sampling, queries, suffix_dedup, token_counts, toxicity, warc

DATA = "/root/testdata/sf0.001"
RANKS, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = db.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    key = lambda r: str(sorted(r.items()))
    rows = [r.asDict() for r in queries.queries()[name](spark, DATA).collect()]
    assert sorted(rows, key=key) == sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for frame in (
        token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN), toxicity.toxicity_scores(docs, labels), toxicity.without_toxic(docs, labels), warc.round_trip(pages), packing.pack(docs, WORDS), fingerprints.fingerprints(docs),
        lattice_lsh.near_vectors(vectors), piece_sampling.round_trip(docs, PIECES), piece_sampling.decoded(piece_sampling.sampled_ids(docs, PIECES), PIECES), suffix_dedup.repeated_bytes(docs), suffix_dedup.without_repeats(docs),
        html_text.extract(pages), near_join.jaccard_components(docs), near_join.keep_one(docs),
    ):
        assert frame.count() == 0


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<p>x</p>", "u", "h", 3), (2, "http://h/b", "<p>x</p>", "u", "h", 3)], "page_id long, url string, html string, uid string, sha string, `lead` int")
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(pages).collect()) == [(1, "revisit"), (2, "response")]
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages.withColumnRenamed("sha", "path").withColumnRenamed("lead", "host")).collect()) == [(1, "x"), (2, "x")]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, "a"), (2, [1.0, 0.001], 5, "b"), (3, [0.0, 1.0], 5, "c")], "vec_id long, embedding array<float>, m int, vid string")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_lsh.near_vectors(vectors).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_by_brute_force(spark, rule):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "the", " ", "\n", "\n\n", "é", "日", ".", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "\n", "no end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder = token_counts.Encoder(RANKS, public_tokenizers.PATTERN)
    want = Counter()
    for i, text in enumerate(texts):
        data = (text or "").encode()
        lines = re.findall(rb"[^\n]*\n|[^\n]+", data) or [b""]
        owner = [k for k, line in enumerate(lines) for _ in line]  # the line of every byte
        counts, crossing, at, total = [0] * len(lines), [0] * len(lines), 0, 0
        for token in encoder.encoding.encode_ordinary(text or ""):
            own = owner[at : at + len(encoder.encoding.decode_single_token_bytes(token))]
            at, total = at + len(own), total + 1
            share = Counter(own)
            counts[own[0] if rule == "start" else own[-1] if rule == "end" else max(sorted(share), key=share.get)] += 1
            for k in share if len(share) > 1 else ():
                crossing[k] += 1
        start = 0
        for k, line in enumerate(lines):
            want[i, k, start, len(line), counts[k], crossing[k], total] += 1
            start += len(line)
    assert Counter(tuple(r) for r in token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN, rule=rule).collect()) == want


def test_long_white_space(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " " * 1_100_000 + "x"), (2, "a" + "\n" * 1_100_000)], "doc_id long, text string")
    out = token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.b for r in out} == {1: 1_100_001, 2: 1_100_001} and all(r.n == r.t for r in out)
    monkeypatch.setattr(token_counts, "LONG_RUN", 3)
    encoder = token_counts.Encoder(RANKS, public_tokenizers.PATTERN)
    for x in ("a   b", "   ", "x    ", "  \n\n\n  y \n\n\n z", "a　　　　b", "é    \n" * 4, "    's", "1    2     ,", "a\x1c\x1c\x1c\x1cb"):
        assert encoder.ids(x).tolist() == encoder.encoding.encode_ordinary(x)


def test_long_units(monkeypatch):
    lattice = piece_sampling.Lattice(PIECES)
    keys = np.arange(3000, dtype=np.uint64)
    tabled = Counter(tuple(x.tolist()) for x in lattice.sample(["the theory"] * 3000, keys, 0))
    monkeypatch.setattr(piece_sampling, "LONG_UNIT", 2)
    placed = Counter(tuple(x.tolist()) for x in lattice.sample(["the theory"] * 3000, keys, 0))
    assert sum(abs(tabled[k] - placed[k]) for k in tabled | placed) < 600  # one distribution
    monkeypatch.setattr(piece_sampling, "LONG_UNIT", 500)
    for text in ("internationalisation\n日本人\tx" * 30, "a" * 1200 + "é\U0001f600 b", "x" * 499 + " " * 700, "abcdé" * 40_000):
        one, two = (lattice.sample([text, "short", text], np.array([5, 6, 5], np.uint64), 0) for _ in range(2))
        assert lattice.decode(one[0]) == text and lattice.decode(one[1]) == "short"
        assert all((a == b).all() for a, b in zip(one, two, strict=True)) and (one[0] == one[2]).all()


LOSING = [
    ('<article><div class="post-header"><h1>Title</h1></div><p>a</p></article>', "Title\na"), ('<div class="share-price"><p>12 EUR</p></div>', "12 EUR"), ('<section id="search-results"><p>found</p></section>', "found"),
    ("<p>a</p><svg><path><p>b</p><div>c</div>", "a\nb\nc"), ("<p>a</p><select><option>x<p>b</p>", "a\nb"), ("<article>" + "<div>" * 501 + "in" + "</div>" * 501 + "</article>after", "in"),
    ('<div class="site-footer">f</div><p>x</p>', "x"), ('<article><p>t</p><div class="comments">no</div><aside>no</aside></article>', "t"), ('<div role="navigation">no</div><p>x &lt;b&gt; y&nbsp;&amp; z</p>', "x <b> y & z"),
    ("<p>one <b>two</b><p>three</i>", "one two\nthree"), ("<title>no</title><p>a<br>b</p><script>no</script><noscript>no</noscript><textarea>no</textarea>", "a b"), ('<a """"""""""""""""""""""""""""""""""""""""" x', ""),
]


@pytest.mark.parametrize("page,text", LOSING)
def test_pages(page, text):
    assert html_text.main_text(html_text.lines_of(page), None) == text


def test_alignment_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdef"[k:]) for _ in range(rng.randint(0, 25))] for k in (0, 1))
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(table[-1][j] + 1 if x == y else max(table[-1][j + 1], row[j]))
            table.append(row)
        found = sorted(html_text.aligned(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)
    lines = [[str(rng.randrange(10_000)) for _ in range(30_000)] for _ in range(2)]
    assert len(html_text.aligned(*lines)) > 100  # a table of them would take 900 million cells
    assert html_text.main_text(html_text.lines_of("<div>" * 200_000 + "</x>" * 200_000 + "x"), None) == "x"


def test_sentences_of_predicted_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(30) + ". " + prose(10) + (" you VILEness. " if i % 4 == 0 else ". ") + prose(30), int(i % 4 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxicity_scores(table, table).collect()
    texts = {i: t for i, t, _ in rows}
    assert sum(r.predicted for r in out) > 60
    for r in out:
        assert bool(r.sentences) == bool(r.predicted)
        if r.predicted and r.doc_id % 4 == 0:
            assert any("VILE" in texts[r.doc_id][s.start : s.end] for s in r.sentences)
    model = toxicity.train(table, table)
    plain = 1.0
    for _, _, z in model.sentences(rows[0][1] + " İX. ẞtraße VILENESS"):
        plain *= 1 / (1 + np.exp(z))
    assert abs(model.score(rows[0][1] + " İX. ẞtraße VILENESS") - (1 - plain)) < 1e-9


def test_meeting_rate():
    """Pairs at cosine 0.95 meet in some table, and sketches keep them."""
    rng = np.random.default_rng(3)
    for d in (64, 256):
        a, b = rng.normal(size=(2, 1500, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        ca, cb = lattice_lsh.cells(a), lattice_lsh.cells(b)
        meet = ((ca[:, :, :1] == cb).any(axis=2) | (cb[:, :, :1] == ca).any(axis=2)).any(axis=1)
        assert meet.mean() > 0.95
        apart = np.bitwise_count(lattice_lsh.sketches(a) ^ lattice_lsh.sketches(b)).sum(axis=1)
        assert (apart <= lattice_lsh.most_apart(0.95)).all()


def test_components_of_vectors_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 16))
    for k in range(0, 200, 4):
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 16)) * rng.choice([0.05, 0.2, 0.3])
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in lattice_lsh.near_vectors(table).collect()}
    links = cosine >= 0.95
    np.fill_diagonal(links, False)
    least = np.arange(240)
    for _ in range(240):
        least = np.array([min([least[i], *least[links[i]]]) for i in range(240)])
    wrong = [i for i in range(240) if (out[i].n_links, out[i].component_id, out[i].kept) != (links[i].sum(), least[i], least[i] == i)]
    assert links.sum() > 100 and len(wrong) <= 0.05 * 240  # vectors meet by chance; links found are true
    assert all(out[i].n_links <= links[i].sum() for i in range(240))


def test_hot_windows_and_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 2)
    monkeypatch.setattr(common, "HEAVY", 5)
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = prose(50)
    docs = spark.createDataFrame([(i, prose(12) + " " + passage + " " + prose(12)) for i in range(30)] + [(100 + i, "one text of these words here") for i in range(40)], "doc_id long, text string")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = Counter(t[j : j + 200] for t in texts.values() for j in range(len(t) - 199))
    for keep_first in (False, True):
        removed = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(docs, keep_first=keep_first).collect()}
        if keep_first:
            assert sum(removed.values()) == sum(max(0, removed[i]) for i in removed) and min(removed[i] for i in range(30)) == 0
        else:
            for i, t in texts.items():
                gone = set()
                for j in range(len(t) - 199):
                    gone.update(range(j, j + 200) if seen[t[j : j + 200]] > 1 else ())
                assert removed[i] == len(gone)
    out = {r.doc_id: r.component_id for r in near_join.jaccard_components(docs).collect()}
    assert all(out[i] == (100 if i >= 100 else i) for i in out)
    assert near_join.keep_one(docs).count() == 31


def test_edited_texts_of_equal_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rng = random.Random(1)
    for ids in ([None] * 20 + list(range(30)), [7] * 25 + list(range(20)) + [None] * 5, [10**k for k in range(19)] + [-(2**63), 2**63 - 1, -5, 0], [3]):
        rows = [(i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 9))) + str(k)) for k, i in enumerate(ids)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashed[r[1]]), reverse=True)
        want = Counter()
        for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            half = len(text) // 2
            want[i, text[: len(text) - half] + after[:half]] += 1
        out = fingerprints.edited_pairs(docs).select("doc_id", "text", "next.text").toDF("doc_id", "text", "after").collect()
        assert Counter((r.doc_id, r.text[: len(r.text) - len(r.text) // 2] + r.after[: len(r.text) // 2]) for r in out) == want


def fingerprint_of(text):
    """One-permutation MinHash with optimal densification, step by step."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def combined(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed

    runs = [hashed[i : i + 5] for i in range(len(hashed) - 4)] or ([hashed] if hashed else [])
    if not runs:
        return ""
    bins = {}
    for run in runs:
        h = combined(run) >> 1
        bins[h >> 55] = min(h, bins.get(h >> 55, h))
    places = fingerprints._places()

    def value(j):
        for own in (j, *(p[j] for p in places)):
            if own in bins:
                return bins[own]
        # the filled bin whose number hashes least together with j
        return min((int.from_bytes(xxhash.xxh64_digest(j.to_bytes(4, "little"), xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)), "big", signed=True), y) for b, y in bins.items())[1]

    low = [value(j) & 255 for j in range(256)]
    return "".join(f"{sum(b << 8 * i for i, b in enumerate(low[k : k + 8])):016X}" for k in range(0, 256, 8))


def test_fingerprints_by_reference(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 5, 6, 7, 12, 40, 200, 900, 4000)] + ["A b\tC\nd e", None, " \t", "word " * 50]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        one, two, nearest = fingerprint_of(text), fingerprint_of(edited), fingerprint_of(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (one, two)
        for found, other in ((got[i].near_edited, two), (got[i].near_next, nearest)):
            if not one or not other:
                assert found == float(one == other)
            else:
                agree = sum(bytes.fromhex(one)[k] == bytes.fromhex(other)[k] for k in range(256)) / 256
                assert found == pytest.approx(max(0.0, (agree - 1 / 256) / (1 - 1 / 256)))
