"""Sampled segmentations over the piece lattice, reproducible by row key, and lossless decoding.

Pieces hold spaces only at their start, so the lattice of a text falls apart at spaces into units; a unit's lattice is
filtered forward once (the total weight of the paths to each place, and the weights of the pieces that end there) and
remembered. Line feeds and tabs, which no longer piece holds, cut units too. A very long unit (text without spaces) is filtered
place by place with one number a character, and is not remembered. Sampling runs backward: at each place a piece that ends there is drawn in proportion to its path weight. Draws come from
a hash of seed, row key, unit and place, so a row's segmentation depends on nothing but its key and text. Characters without
a piece fall back to byte pieces; so does a literal word mark, which keeps decoding exact.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import bounded_batches

#: Weight of a piece: exp(-ALPHA * its rank - PENALTY).
ALPHA, PENALTY = 1 / 4000, 2.0
MEMORY_UNITS = 700_000
#: Units up to so many characters are filtered in plain weights, where at worst e to the -42 comes with each character. Only
#: paths over pieces of spaces alone, whose rank is a billion, vanish there; units with no other path, and longer units,
#: are filtered in logarithms.
PLAIN_LENGTH = 16
#: Characters of text that are sampled at once.
GROUP_CHARS = 1_000_000
#: Characters of a unit above which its lattice is not kept, and those of which candidates are held at once.
LONG_UNIT = 5_000
_CUTS = "\n\t\r"
_HELD: dict = {}


class Lattice:
    """The pieces of a model with byte fallback, and the forward-filtered lattices of units seen so far."""

    def __init__(self, model: str, alpha: float = ALPHA, penalty: float = PENALTY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            else:
                text = piece.replace("▁", " ")
                self.pieces[text] = (i, -alpha * -sp.get_score(i) - penalty)
                self.bytes_of[i] = text.encode()
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        self.weights = np.zeros(len(self.bytes_of))
        self.sizes = np.zeros(len(self.bytes_of), np.int64)
        for text, (i, w) in self.pieces.items():
            self.finder.add_word(text, i)
            self.weights[i], self.sizes[i] = w, len(text)
        self.finder.make_automaton()
        self.plain = np.exp(self.weights)
        self.longest = int(self.sizes.max())
        cuts = "".join(c for c in _CUTS if not any(c in x for x in self.pieces if len(x) > 1))
        self.unit = re.compile(rf" +[^ {cuts}]*|[{cuts}]|[^ {cuts}]+" if cuts else r" +[^ ]*")
        self.fallback = -alpha * len(self.bytes_of) - penalty
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        #: Of all units end to end: candidates at each place; share, length and id of each candidate.
        self.table = [kernels.Column(t) for t in (np.int16, np.float64, np.int16, np.int32)]
        self.nodes, self.candidates, self.lengths = (kernels.Column(np.int64) for _ in range(3))

    def learn(self, units: list[str]) -> None:
        """Forward-filter the lattices of ``units``, those of one length together.

        A candidate's id is its piece's; a character without a piece has minus its code point, less one, and is spelled in
        byte pieces.
        """
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for n, whole in by_length.items():
            most = max(1, 2_000_000 // (n * min(n, self.longest)))
            for i in range(0, len(whole), most):
                rest = self._learn(n, whole[i : i + most], n <= PLAIN_LENGTH)
                if rest:
                    self._learn(n, rest, False)

    def _learn(self, n: int, units: list[str], plain: bool) -> list[str]:
        """Remember the lattices of ``units``, of ``n`` characters each; returns those that plain weights cannot tell."""
        wide = min(n, self.longest)
        found = np.fromiter(itertools.chain.from_iterable(self.finder.iter("".join(units))), np.int64)
        ends, pieces = found[::2], found[1::2]
        size = self.sizes[pieces]
        inside = size <= ends % n + 1  # matches over two units are none
        ends, pieces, size = ends[inside], pieces[inside], size[inside]
        # By place, length and unit, so that each step below runs over whole rows of units.
        ids = np.zeros((n, wide, len(units)), np.int32)
        ids[ends % n, size - 1, ends // n] = pieces
        weight = np.zeros(ids.shape) if plain else np.full(ids.shape, -np.inf)
        weight[ends % n, size - 1, ends // n] = (self.plain if plain else self.weights)[pieces]
        for e, k in zip(*np.nonzero(ids[:, 0] == 0), strict=True):
            c = units[k][e]
            weight[e, 0, k] = self.fallback * len(c.encode())
            if plain:
                weight[e, 0, k] = math.exp(weight[e, 0, k])
            ids[e, 0, k] = -ord(c) - 1
        total = np.full((n + 1, len(units)), float(plain))
        for e in range(1, n + 1):
            most = min(e, wide)
            x, before = weight[e - 1, :most], total[e - most : e][::-1]
            if plain:
                x *= before
                np.cumsum(x, axis=0, out=x)
                total[e] = x[-1]
                x /= np.where(total[e] > 0, total[e], 1.0)  # a place of weight 0 is never drawn
            else:
                x += before
                top = x.max(axis=0)
                np.exp(x - top, out=x)
                np.cumsum(x, axis=0, out=x)
                total[e] = top + np.log(x[-1])
                x /= x[-1].copy()
        rest = []
        if plain and not total[n].all():
            rest = [u for u, w in zip(units, total[n], strict=True) if w == 0]
            units = [u for u, w in zip(units, total[n], strict=True) if w > 0]
            if not units:
                return rest
            ids, weight = ids[:, :, total[n] > 0], weight[:, :, total[n] > 0]
        ids, weight = np.ascontiguousarray(ids.transpose(2, 0, 1)), weight.transpose(2, 0, 1)
        have = ids != 0
        lengths = np.broadcast_to(np.arange(1, wide + 1, dtype=np.int16), have.shape)[have]
        counts = have.sum(axis=2)
        shares = np.minimum(weight[have], 1.0)
        shares[np.cumsum(counts.ravel()) - 1] = 1.0
        first = len(self.units)
        self.units.update(zip(units, range(first, first + len(units)), strict=True))
        per_unit = counts.sum(axis=1)
        self.lengths.add(np.full(len(units), n))
        self.nodes.add(self.table[0].size + np.arange(len(units)) * n)
        self.candidates.add(self.table[1].size + np.cumsum(per_unit) - per_unit)
        for column, values in zip(self.table, (counts.ravel(), shares, lengths, ids[have]), strict=True):
            column.add(values)
        return rest

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Ids of each text; ``keys``: one unsigned 64-bit key a text."""
        if len(self.units) > MEMORY_UNITS:
            self.forget()
        split = [self.unit.findall(" " + t) for t in texts]
        flat = list(itertools.chain.from_iterable(split))
        per_row = np.array([len(x) for x in split])
        row = np.repeat(np.arange(len(texts)), per_row)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        salt = kernels.mix(keys + kernels.U(seed))[row] + number.astype(kernels.U) * kernels.U(0x9E3779B97F4A7C15)
        long = [k for k, u in enumerate(flat) if len(u) > LONG_UNIT] if max(map(len, flat), default=0) > LONG_UNIT else []
        if not long:
            out, owner = self._drawn(flat, salt)
        else:
            short = np.setdiff1d(np.arange(len(flat)), long)
            found = [self._drawn([flat[k] for k in short], salt[short])] if len(short) else []
            out, owner = [x[0] for x in found], [short[x[1]] for x in found]
            for k in long:
                out.append(self._long(flat[k], salt[k]))
                owner.append(np.full(len(out[-1]), k))
            out, owner = np.concatenate(out), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
        odd = np.flatnonzero(out < 0)
        if len(odd):
            spelled = [[self.byte_ids[b] for b in chr(-int(out[i]) - 1).encode()] for i in odd]
            repeat = np.ones(len(out), np.int64)
            repeat[odd] = [len(x) for x in spelled]
            ends = np.cumsum(repeat)
            out, owner = np.repeat(out, repeat), np.repeat(owner, repeat)
            for i, x in zip(odd, spelled, strict=True):
                out[ends[i] - len(x) : ends[i]] = x
        return np.split(out.astype(np.int32), np.cumsum(np.bincount(row[owner], minlength=len(texts)))[:-1])

    @staticmethod
    def _uniform(salt: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (kernels.mix(salt + at.astype(kernels.U) * kernels.U(0xD1B54A32D192ED03)) >> kernels.U(11)).astype(np.float64) * 2.0**-53

    def _drawn(self, flat: list[str], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates drawn for each unit, end to end, and the unit of each."""
        coded = pa.array(flat, pa.string()).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([u for u in names if u not in self.units])
        known = np.fromiter(map(self.units.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        order = np.argsort(known)  # draws go through the table in its order
        new = np.diff(known[order], prepend=-1) > 0
        at_unit, unit = known[order][new], np.empty(len(flat), np.int64)
        unit[order] = np.cumsum(new) - 1
        sizes = self.lengths.data[at_unit]
        node0 = np.cumsum(sizes) - sizes
        counts = self.table[0].data[kernels.ranges(self.nodes.data[at_unit], sizes)].astype(np.int64)
        first = np.cumsum(counts) - counts
        pick = kernels.ranges(self.candidates.data[at_unit], np.add.reduceat(counts, node0))
        table = self.table[1].data[pick] + np.repeat(np.arange(len(counts)), counts)
        steps, ids = self.table[2].data[pick], self.table[3].data[pick]
        at, live, drawn = sizes[unit], order, []
        while len(live):
            node = node0[unit[live]] + at[live] - 1
            u = self._uniform(salt[live], at[live])
            pick = np.minimum(np.searchsorted(table, node + u, side="right"), first[node] + counts[node] - 1)
            at[live] -= steps[pick]
            drawn.append((live, ids[pick]))
            live = live[at[live] > 0]
        taken = np.zeros(len(unit), np.int64)
        for units_now, _ in drawn:
            taken[units_now] += 1
        ends = np.cumsum(taken)
        out, owner = np.empty(ends[-1], np.int64), np.repeat(np.arange(len(unit)), taken)
        for step, (units_now, drawn_ids) in enumerate(drawn):  # the last piece of a unit is drawn first
            out[ends[units_now] - 1 - step] = drawn_ids
        return out, owner

    def _ending(self, unit: str, lo: int, hi: int) -> list[list[tuple[int, int, float]]]:
        """(length, id, weight) of the candidates that end at each place from ``lo`` to before ``hi``."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(hi - lo)]
        begin = max(0, lo - self.longest + 1)
        sizes, weights = self.sizes, self.weights
        for end, piece in self.finder.iter(unit[begin:hi]):
            end += begin - lo
            if end >= 0:
                out[end].append((int(sizes[piece]), piece, float(weights[piece])))
        for e, some in enumerate(out):
            if not any(n == 1 for n, _, _ in some):
                c = unit[lo + e]
                some.append((1, -ord(c) - 1, self.fallback * len(c.encode())))
        return out

    def _long(self, unit: str, salt: np.uint64) -> np.ndarray:
        """The candidates drawn for one long unit: forward with the logarithm of each place's weight, then backward."""
        n, exp, log = len(unit), math.exp, math.log
        total = np.zeros(n + 1)
        recent = [0.0]  # of the last places
        for lo in range(0, n, LONG_UNIT):
            hi = min(lo + LONG_UNIT, n)
            for some in self._ending(unit, lo, hi):
                w = [x + recent[-k] for k, _, x in some]
                top = max(w)
                recent.append(top + log(sum([exp(x - top) for x in w])))
            total[lo + 1 : hi + 1] = recent[lo - hi :]
            recent = recent[-self.longest :]
        out, at = [], n
        for lo in range((n - 1) // LONG_UNIT * LONG_UNIT, -1, -LONG_UNIT):
            hi = min(lo + LONG_UNIT, n)
            ending, base = self._ending(unit, lo, hi), max(0, lo - self.longest)
            held, u = total[base : hi + 1].tolist(), self._uniform(np.full(hi - lo, salt), np.arange(lo + 1, hi + 1)).tolist()
            while at > lo:
                some, rest = ending[at - 1 - lo], u[at - 1 - lo]
                for size, piece, w in some:
                    rest -= exp(w + held[at - size - base] - held[at - base])
                    if rest < 0:
                        break
                out.append(piece)
                at -= size
        return np.array(out[::-1], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text whose sampling gave ``ids``: joined pieces without the space before the first."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()[1:]


def _sampled(model: str, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _HELD:
            _HELD[model] = Lattice(model)
        lattice = _HELD[model]
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy().view(kernels.U)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= GROUP_CHARS):
                    size += len(texts[hi])
                    hi += 1
                ids = lattice.sample(texts[lo:hi], keys[lo:hi], seed)
                doc_id = batch.column("doc_id").slice(lo, hi - lo)
                if digest:
                    same = [lattice.decode(x) == t for x, t in zip(ids, texts[lo:hi], strict=True)]
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                lo = hi

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    doc_id = F.col(f"`{id_col}`").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def sampled_ids(docs: DataFrame, model: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: one segmentation drawn from the lattice of the whole text.

    Draws follow the id, so repeated rows get equal ids; a null id has a key of its own; a null text is empty. Every text,
    the empty one too, begins with the piece of a space. Other columns are ignored, an empty table gives no rows.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_sampled(model, seed, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, model: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of ``sampled_ids`` and their decoding."""
    return _rows(docs, id_col, text_col).mapInArrow(_sampled(model, seed, True), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _HELD:
            _HELD[model] = Lattice(model)
        for batch in batches:
            texts = [None if x is None else _HELD[model].decode(np.array(x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
