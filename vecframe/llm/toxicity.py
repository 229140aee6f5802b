"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is.

A sentence's probability is the logistic of a bias and its words' weights; a text's is the noisy-or of its sentences'. Only
texts have labels. Features are whole words and their first 3 to 7 letters, so that inflected forms share evidence. The
model is a bounded table of weights, fitted on the driver on a bounded sample of labelled rows; scoring reads every text
whole, on the executors, word by word from a remembered weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh
from .kernels import release

#: Labelled rows that the fit takes at most, of each label, by the order of a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: The model's size: features kept at most, and the least standard score that a feature needs, against chance words.
FEATURES, LEAST_Z = 6000, 3.0
THRESHOLD = 0.7
#: Words whose weight a worker remembers.
MEMORY_WORDS = 100_000
PREFIXES = (3, 4, 5, 6, 7)
_PIECES = re.compile(r"[^\W_]+|[.!?\n]+")
_ENDS = ".!?\n"


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_words": {}}

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with a word."""
        out, begin, z, any_word = [], 0, self.bias, False
        for m in _PIECES.finditer(text):
            piece = m[0]
            if piece[0] in _ENDS:  # as in ``score``
                if any_word:
                    out.append((begin, m.end(), z))
                begin, z, any_word = m.end(), self.bias, False
            else:
                z += self.word(piece.lower())
                any_word = True
        if any_word:
            out.append((begin, len(text), z))
        return out

    def score(self, text: str) -> float:
        """Noisy-or of the sentences; a text without words has the score of one plain sentence."""
        known = self._words
        if len(known) > MEMORY_WORDS:
            known.clear()
        pieces = _PIECES.findall(text)
        values = list(map(known.get, pieces))
        if None in values:
            for p in {p for p, v in zip(pieces, values, strict=True) if v is None}:
                known[p] = np.nan if p[0] in _ENDS else self.word(p.lower())
            values = list(map(known.__getitem__, pieces))
        z = np.array([*values, np.nan])
        ends = np.isnan(z)
        starts = np.flatnonzero(np.concatenate(([True], ends[:-1])) & ~ends)
        if not len(starts):
            return float(1 / (1 + np.exp(-self.bias)))
        z[ends] = 0.0
        logits = np.add.reduceat(z, starts) + self.bias
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at or above ``least``, in order; if there is none, of the likeliest."""
        found = [(s, e, float(1 / (1 + np.exp(-z)))) for s, e, z in self.sentences(text)]
        return [x for x in found if x[2] >= least] or sorted(found, key=lambda x: -x[2])[:1]


def fit(rows: Iterator[tuple[str, int]], share: float | None = None, steps: int = 400) -> Model:
    """The model of (text, label) rows. ``share``: the part of toxic texts in the table the rows were drawn from.

    Without both labels among the rows, nothing can be learnt: every score is the plain sentence's, near 0 or near 1.
    """
    words: dict[str, int] = {}
    docs, labels = [], []
    for text, label in rows:
        ids = [-1 if p[0] in _ENDS else words.setdefault(p, len(words)) for p in map(str.lower, _PIECES.findall(text or ""))]
        docs.append(np.array([*ids, -1], np.int32))
        labels.append(int(label))
    y = np.array(labels, bool)
    pos, neg = int(y.sum()), int((~y).sum())
    if not pos or not neg:
        return Model(bias=20.0 if pos else -20.0)
    names = [features(w) for w in words]
    seen = (Counter(), Counter())
    for ids, label in zip(docs, y, strict=True):
        seen[int(label)].update({f for i in np.unique(ids) if i >= 0 for f in names[i]})
    scored = []
    for f, a in seen[1].items():
        b = seen[0][f]
        p = (a + b) / (pos + neg)
        z = (a / pos - b / neg) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / pos + 1 / neg))
        if a >= 2 and z >= LEAST_Z:
            scored.append((z, f))
    chosen = [f for _, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:FEATURES]]
    index = {f: i for i, f in enumerate(chosen)}
    hits = [np.array([index[f] for f in n if f in index], np.int32) for n in names]
    some = np.array([len(h) > 0 for h in hits], bool)
    sent, feat, owner, plain = [], [], [], np.zeros(len(docs))
    count = 0
    for d, ids in enumerate(docs):
        cuts = np.flatnonzero(ids < 0)
        for a, b in zip(np.concatenate(([0], cuts[:-1] + 1)), cuts, strict=True):
            inside = ids[a:b]
            if not len(inside):
                continue
            inside = inside[some[inside]]
            if not len(inside):
                plain[d] += 1
                continue
            f = np.concatenate([hits[i] for i in inside])
            sent.append(np.full(len(f), count))
            feat.append(f)
            owner.append(d)
            count += 1
    sent, feat = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sent, feat))
    owner = np.array(owner, np.int64)
    share = pos / (pos + neg) if share is None else share
    weight = np.where(y, share / pos, (1 - share) / neg)
    theta = np.concatenate(([-6.0], np.full(len(chosen), 0.3)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    decay = 1e-5
    for t in range(1, steps + 1):
        b = theta[0]
        z = b + np.bincount(sent, theta[1:][feat], count)
        soft = np.bincount(owner, np.logaddexp(0, z), len(docs)) + plain * np.logaddexp(0, b)
        pull = np.where(y, -1 / np.maximum(np.expm1(np.minimum(soft, 500)), 1e-9), 1.0) * weight
        dz = pull[owner] / (1 + np.exp(-z))
        db = dz.sum() + (pull * plain).sum() / (1 + np.exp(-b))
        g = np.concatenate(([db], np.bincount(feat, dz[sent], len(chosen)) + decay * theta[1:]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(float(theta[0]), {f: float(w) for f, w in zip(chosen, theta[1:], strict=True)})


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows that are not held out.

    Several labels of one id count as their mean, toxic from a half on; null ids and labels are passed over.
    """
    known = labels.where(~held_out(id_col)).select(F.col(f"`{id_col}`").cast("long").alias("lid"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    known = known.groupBy("lid").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("lid")
    chosen = [known.where(F.col("y") == y).orderBy(order, "lid").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # bounded by the two limits
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("lid"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).join(chosen, "lid")
    rows = rows.groupBy("lid").agg(F.min("t").alias("t"), F.min("y").alias("y")).orderBy(order, "lid")
    share = total.get(1, 0) / max(1, sum(total.values()))
    return fit(((r["t"], r["y"]) for r in rows.toLocalIterator()), share)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: each text's probability; null texts count as empty."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        out = texts.map(lambda t: model.score(t or "")).astype("float64")
        release()
        return out

    return docs.withColumn(name, score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, sentence, score) of the sentences at or above ``least``; characters, end exclusive.

    Null and empty texts and texts without words have none; repeated rows give theirs each, null ids are kept, other columns
    are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e, t[s:e], p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for s, e, p in model.offending(t, least) if p >= least]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _located(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [model.score(t) for t in texts]
            spans = [[dict(zip(("start", "end", "score"), x, strict=True)) for x in model.offending(t)] if s >= THRESHOLD else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "score", "sentences"])
            release()

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD), sentences.

    ``sentences`` are the spans (start, end in characters, score) of a predicted text that offend by ``Model.offending``;
    empty for others. Only the text enters a score, so repeated rows score alike; null and empty texts score as one plain
    sentence. Null ids are never held out. Without usable labels all scores are near 0. An empty table gives no rows; columns
    other than id and text are ignored.
    """
    model = train(docs, labels, id_col, text_col)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_located(model), "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under THRESHOLD, with all their columns, whatever their names.

    Texts score as in ``toxicity_scores``, so null and empty texts stay where plain sentences do; an empty table stays empty.
    """
    name = fresh(docs, "score")
    return scored(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < THRESHOLD).drop(name)
