"""Each operator against brute force on a small table with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecframe.llm import common, fingerprints, html_text, lattice_lsh, near_join, packing, piece_sampling, suffix_dedup, token_counts, toxicity, warc

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY) + RNG.choice(["", "", ".", "\n"]) for _ in range(n))


BASE = [prose(RNG.randint(20, 120)) for _ in range(30)]
PASSAGE = prose(60)
TEXTS = [*BASE, BASE[0], BASE[1] + " end", BASE[2] + "\n" + PASSAGE, PASSAGE + BASE[3], None, "", " \t", "one", "one two", "é ﬁ ▁ x\x1cy  z　w <|endoftext|>", "ab" * 900, prose(4000), BASE[0].upper(), "word " * 300]
SCHEMA = "doc_id long, text string, uid string, score int, spans int, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "u", 1, 2, len(t or "")) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "u", 1, 2, len(TEXTS[5])), (None, BASE[7], "u", 1, 2, len(BASE[7]))]
    return common.materialize(spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id"))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return text.encode().lower().split()


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_join(docs, rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    expected = Counter((rows[i][0], len(sets[i]), min([x for x in members[find(i)] if x is not None], default=None)) for i in range(len(rows)))
    assert Counter(tuple(r) for r in near_join.jaccard_components(docs).collect()) == expected
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert near_join.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1024, 1])
def test_suffix_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    data = [t.encode() for _, t in rows]
    seen = Counter(d[j : j + 200] for d in data for j in range(len(d) - 199))
    expected = Counter()
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for j in range(len(d) - 199):
            if seen[d[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        expected[i, len(d), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.repeated_bytes(docs).collect()) == expected
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    again = Counter(d[j : j + 200] for d in (r.text.encode() for r in left.collect() if r.text) for j in range(len(d) - 199))
    text = PASSAGE.encode()
    assert all(again[text[j : j + 200]] == 1 for j in range(len(text) - 199))  # one copy stays
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).toPandas()
    expected = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    starts = pieces[pieces.start == 0]
    assert Counter(zip([None if x != x else int(x) for x in starts.doc_id], starts.doc_tokens, strict=True)) == expected
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s.length.sum())
        assert (s.length.cumsum() - s.length == s.offset).all() and total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    for p in pieces[pieces.doc_id.notna()].itertuples():
        assert zlib.crc32(ids[int(p.doc_id)][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert packing.pack(docs.limit(0), path).count() == 0
    have = np.zeros(2048, np.int64)
    have[[100, 700, 1248, 800, 1024]] = [50, 50, 80, 30, 9]
    used = Counter()
    for lengths, n in packing.plan(have):
        assert sum(lengths) == 2048
        for v in lengths:
            used[v] += n
    assert all(used[v] <= have[v] for v in used) and used[1248] == 80


def test_toxicity(spark, docs):
    rng = random.Random(1)
    rows = [(i, prose(80) + (". you vile" + rng.choice(["ness", "ly", "st"]) + " thing. " if i % 4 == 0 else ". ") + prose(40), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_scores(table, table.select("doc_id", "toxic")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in out if out[i].held_out} == set(held)
    assert np.mean([out[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    model = toxicity.train(table, table)
    found = toxicity.offending_sentences(table, model).toPandas()
    assert found.sentence.str.contains("vile").mean() > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).where("text is null or length(trim(text)) = 0").collect())
    plain = toxicity.toxicity_scores(docs, docs.selectExpr("doc_id", "0 as toxic"))
    assert plain.where("predicted = 1").count() == 0 and plain.count() == docs.count()
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = token_counts.Encoder(path, public_tokenizers.PATTERN)
    out = token_counts.section_tokens(docs, path, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_bytes").alias("b"), F.count("*").alias("k")).collect()
    expected = defaultdict(lambda: [0, 0, 0])
    for i, t in rows:
        for k, v in enumerate((len(encoder.encoding.encode_ordinary(t)), len(t.encode()), max(1, len(t.encode().split(b"\n")) - t.endswith("\n")))):
            expected[i][k] += v
    assert {r.doc_id: [r.n, r.b, r.k] for r in out} == dict(expected)
    counts, crossing = token_counts.attribute(np.array([3, 7, 10]), np.array([0, 4, 9]), "largest")
    assert counts.tolist() == [1, 2, 0] and crossing.tolist() == [1, 2, 1]  # 7-10 has two bytes before 9
    assert token_counts.attribute(np.array([3, 7, 10]), np.array([0, 4, 9]), "start")[0].tolist() == [2, 1, 0]


def test_fingerprints(docs, rows):
    out = fingerprints.fingerprints(docs)
    got = {r.doc_id: r for r in out.collect()}
    order = sorted(((i, t) for i, t in dict(rows).items() if i is not None and i != 5), reverse=True)
    assert out.count() == len(rows) and "PythonUDF" not in out._jdf.queryExecution().toString()
    for (i, t), (j, n) in zip(order, order[1:], strict=False):
        if i == 6 or j != i - 1:
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = grams(t), grams(edited)
        if a and b and t.isascii():
            assert abs(len(a & b) / len(a | b) - got[i].near_edited) < 0.2
    assert got[0].fingerprint == got[TEXTS.index(BASE[0], 1)].fingerprint
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32))
    x[200:290] = x[:90] + rng.normal(size=(90, 32)) * 0.12
    x[150:200] = x[150] + rng.normal(size=(50, 32)) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 32), (302, [float("nan")] * 32), (303, [1.0, 2.0]), (304, [2.0, 4.0]), (0, [float(v) for v in x[0]]), (None, [9.0] * 32), (305, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2048, 16):
        lattice_lsh.BLOCK = block
        out = lattice_lsh.near_vectors(table).collect()
        assert len(out) == len(rows)
        links = {r.vec_id: r.n_links for r in out if r.vec_id != 0}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
        true += (unit @ unit[0] >= 0.95)  # row 0 twice
        found = np.array([links[i] for i in range(1, 300)])
        assert (found <= true[1:]).all() and found.sum() >= 0.9 * true[1:].sum() > 0
        assert links[300] == links[301] == links[302] == links[305] == 0 and links[303] == links[304] == 1
        assert all(r.component_id == r.vec_id for r in out if r.vec_id in (300, 301, 302))
    lattice_lsh.BLOCK = 2048
    points = lattice_lsh.decode(rng.normal(size=(500, 8)) * 3)
    assert np.allclose((points * 2) % 1, 0) and np.allclose(points.sum(axis=1) % 2, 0) and len(lattice_lsh.shortest_vectors()) == 240


def test_piece_sampling(docs, rows):
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_sampling.sampled_ids(docs, model)
    back = Counter((r.doc_id, r.text) for r in piece_sampling.decoded(ids, model).collect())
    assert back == Counter(rows)
    a, b, c = (Counter((r.doc_id, r.ids_crc32) for r in piece_sampling.round_trip(d, model, s).collect()) for d, s in ((docs, 0), (docs.repartition(7), 0), (docs, 1)))
    assert a == b != c
    lattice = piece_sampling.Lattice(model)
    draws = lattice.sample(["the theory"] * 2000, np.arange(2000, dtype=np.uint64), 0)
    seen = Counter(tuple(x.tolist()) for x in draws)
    assert len(seen) > 3 and all(lattice.decode(np.array(k)) == "the theory" for k in seen)
    lattice.forget()
    for unit in (" the", " theory", "  ab", " 日本人", " \U0001f600\U0001f9ff", "   ", " internationalisation"):  # plain weights and logarithms
        lattice.learn([unit])
        at, total = lattice.candidates.data[lattice.units[unit]], [0.0]
        for end in range(1, len(unit) + 1):
            paths = [(n, lattice.pieces[unit[end - n : end]][1] + total[end - n]) for n in range(1, min(end, lattice.longest) + 1) if unit[end - n : end] in lattice.pieces]
            if unit[end - 1] not in lattice.pieces:
                paths.insert(0, (1, lattice.fallback * len(unit[end - 1].encode()) + total[end - 1]))
            total.append(float(np.logaddexp.reduce([w for _, w in paths])))
            part = slice(at, at + len(paths))
            assert lattice.table[2].data[part].tolist() == [n for n, _ in paths]
            assert np.allclose(lattice.table[1].data[part], np.cumsum(np.exp([w - total[-1] for _, w in paths])), atol=1e-9)
            at += len(paths)


def test_warc(spark, tmp_path):
    big = "x" * (3 * warc.CHUNK + 5)
    rows = [(1, "http://a/1", "same"), (2, "http://a/2 \r\nb", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (None, "u", "other"), (2, "u", "same"), (6, "u", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id in (1, 2, 3, 4)) == Counter([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "revisit", 4), (4, "response", None)])
    root = f"file://{tmp_path}/w"
    chunks = warc.read_archives(warc.write_archives(pages, root), root).where("page_id = 5").orderBy("chunk").collect()
    assert len(chunks) > 2 and b"".join(c.data for c in chunks).decode() == big and chunks[-1]["last"]
    sha = hashlib.sha1()
    for c in chunks:
        sha.update(c.data)
        assert c.payload_digest == base64.b32encode(sha.digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_html(spark):
    frame = "<div>Site name</div><p>Menu of all</p>"
    rows = [
        (1, "http://h/a/1", "<html><nav>menu</nav><article><header><h1>T &amp; U</h1></header><p>one <b>two</b><p>three<div class='comments'>no</div></article><footer>f</footer>"),
        (2, "http://h/a/2", f"<body>{frame}<p>first page</p><div class=ad>buy</div><script>var a='<p>x</p>'</script></body>"),
        (3, "http://h/a/3", f"<body>{frame}<p>second  \n page</p><!-- c --></body>"),
        (4, None, None), (5, "odd", "plain"), (2, "http://h/a/2", f"<body>{frame}<p>first page</p></body>"),
    ]
    out = {(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {(1, "T & U\none two\nthree"), (3, "second page"), (4, ""), (5, "plain")} <= out
    assert html_text.aligned(list("abcde"), list("axcye")) == {0, 2, 4}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns
            docs = common.materialize(docs)
            counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
