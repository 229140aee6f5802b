"""Packing of tokenized documents into windows, by non-negative least squares over length combinations.

Documents are cut into full windows from their start; what remains (under one window) is packed by plan. The histogram of
remainders has at most WINDOW - 1 entries whatever the corpus, so the plan is made on the driver: all combinations of up to
three lengths that fill a window exactly, repeat counts by non-negative least squares against the histogram, rounded, then
the residual histogram, whole and greedily, into windows of any number of lengths. Only remainders that find no place in a
full window are cut, at powers of two, and packed largest piece first: such pieces fill windows without gaps, and the last
ones form sequences whose size is a power of two, so nothing is padded.

Every document finds its place from its rank among the remainders of its length: an offset for each (group, length), summed
over groups, plus the rank in its group. Groups are even whatever the lengths, so copies of one document do not meet in a task.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .kernels import Column, ranges

WINDOW = 2048
EOS = 1
#: Documents in a group, about.
GROUP_ROWS = 4096
#: Words, and pieces, whose ids a worker remembers; the memory is emptied when it is full.
MEMORY_WORDS = 800_000
_WORD_END = "</w>"
#: ASCII and letters whose lower case and normal form stand by themselves.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own split of such words, in lower case, and the line feeds between them.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+|\n")
_HELD: dict = {}
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of texts, from a remembered table of words.

    The tokenizer puts a text in lower case, drops white space, splits what is left by a pattern and never joins over a split,
    so a text's ids are those of its words, and a word's those of its pieces. Words of the letters of _PLAIN are split here
    and their pieces encoded once; others are encoded whole. The last id of a piece alone has the mark of a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for pieces of plain words: they are in normal form and split already, their bytes alone are spelled.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(_WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the memory: the word 0 is the end of a text, an empty word has no ids."""
        self.words, self.pieces = Ids(), Ids()
        self.words.add([None, ""], np.array([EOS]), np.array([1, 0]))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 200):
            part = new[i : i + 200]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                each = [self._ids(x) for x in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.pieces.add(part, ids, np.diff(ends, prepend=0))

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w) and "<|" not in w]
        if len(plain) < len(words):
            for w in set(words).difference(plain):
                ids = self._ids(w)
                self.words.add([w], ids, np.array([len(ids)]))
        flat = _PIECE.findall("\n".join([*plain, ""]).lower())
        known = self.pieces.known
        self._learn_pieces(list(set(flat).difference(known, ("\n",))))
        known["\n"] = -1
        at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        end = at < 0
        ids, sizes = self.pieces.gather(at[~end])
        owner = (np.cumsum(end) - end)[~end]
        self.words.add(plain, ids, np.bincount(owner, sizes, len(plain)).astype(np.int64))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text with EOS after them."""
        if len(self.words.known) > MEMORY_WORDS or len(self.pieces.known) > MEMORY_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        local, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.words.known
        at = np.fromiter(map(known.get, local, itertools.repeat(-1)), np.int64, len(local))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [local[k] for k in missing.tolist()]
            self.learn(new)
            at[missing] = list(map(known.__getitem__, new))
        whole = np.zeros(counts.sum() + len(counts), np.int64)  # the end of a text where nothing else is
        whole[np.arange(counts.sum()) + np.repeat(np.arange(len(counts)), counts)] = at[coded.indices.to_numpy()]
        ids, sizes = self.words.gather(whole)
        ends = np.cumsum(sizes)[np.cumsum(counts + 1) - 1]
        yield from np.split(ids, ends[:-1]) if len(counts) else ()


class Ids:
    """Ids of remembered strings, end to end."""

    def __init__(self):
        self.known: dict[str | None, int] = {}
        self.ids, self.starts, self.sizes = Column(np.dtype("<u4")), Column(np.int64), Column(np.int64)

    def add(self, new: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(new, range(self.starts.size, self.starts.size + len(new)), strict=True))
        self.starts.add(self.ids.size + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.ids.add(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings of numbers ``at``, end to end, and how many each has."""
        sizes = self.sizes.data[at]
        return self.ids.data[ranges(self.starts.data[at], sizes)], sizes


def _tokenize(path: str):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD[path] = WordIds(path)
        for batch in batches:
            rows = []
            for ids in _HELD[path].encode(batch.column("text")):
                n, view = len(ids), memoryview(ids).cast("B")
                full = [zlib.crc32(view[i * 4 : (i + WINDOW) * 4]) for i in range(0, n - WINDOW + 1, WINDOW)]
                at, bits = len(full) * WINDOW, []
                rest = n - at
                crc = zlib.crc32(view[at * 4 :])
                for k in range(WINDOW.bit_length() - 2, -1, -1):
                    if rest >> k & 1:
                        bits.append(zlib.crc32(view[at * 4 : (at + (1 << k)) * 4]))
                        at += 1 << k
                rows.append((n, full, rest, crc, bits))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[2:], strict=True))], names=["uid", "doc_id", "doc_tokens", "full", "rest", "crc", "bits"])

    return run


def combinations(have: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All combinations of up to three lengths of those present that fill the window, as rows (a, b, c); c is 0 in pairs."""
    some = have > 0
    a = np.arange(1, window // 2 + 1)
    a = a[some[a] & some[window - a]]
    out = [np.stack((a, window - a, np.zeros_like(a)), axis=1)]
    for a in range(1, window // 3 + 1):
        if some[a]:
            b = np.arange(a, (window - a) // 2 + 1)
            b = b[some[b] & some[window - a - b]]
            out.append(np.stack((np.full_like(b, a), b, window - a - b), axis=1))
    return np.concatenate(out)


def repeat_counts(columns: np.ndarray, have: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares by coordinate descent: x >= 0 that brings the columns' lengths near the histogram.

    A sweep goes over the columns that can still move; the last is the one in which no count moves by a half or, where counts
    are large, by a hundredth of the largest.
    """
    x, rest = np.zeros(len(columns)), have.astype(float)
    rest[0] = 0.0  # the third length of pairs; it has no weight
    same = np.stack((columns[:, 0] == columns[:, 1], columns[:, 1] == columns[:, 2]), axis=1).sum(axis=1)
    norm = (columns > 0).sum(axis=1) + 2 * same + 2 * (same == 2)  # squares of how often a length occurs
    for _ in range(sweeps):
        gain = rest[columns].sum(axis=1)
        now, moved = rest.tolist(), 0.0
        some = np.flatnonzero((gain > 0.1) | ((x > 0) & (gain < -0.1)))
        for j, (a, b, c), held, size in zip(some.tolist(), columns[some].tolist(), x[some].tolist(), norm[some].tolist(), strict=True):
            step = (now[a] + now[b] + now[c]) / size
            if step < -held:
                step = -held
            if step:
                x[j] = held + step
                now[a] -= step
                now[b] -= step
                now[c] -= step
                now[0] = 0.0
                if abs(step) > moved:
                    moved = abs(step)
        rest = np.array(now)
        if moved < max(0.5, x.max(initial=0.0) / 100):
            break
    return x


def plan(have: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): never more of a length than there is; each fills the window.

    Counts are solved and rounded; what they leave is packed whole and greedily, longest first, by pairs and triples, then each
    time with the longest length that fits. Lengths that fill no window this way are left out.
    """
    columns = combinations(have, window)
    x, left, out = repeat_counts(columns, have), have.astype(np.int64).copy(), []

    def take(lengths: tuple[int, ...], most: int) -> None:
        n = min([most, *(int(left[v]) // lengths.count(v) for v in set(lengths))])
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((lengths, n))

    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        take(tuple(v for v in columns[j].tolist() if v), round(float(x[j])))
    for a in range(window - 1, 0, -1):
        while left[a]:
            before = left[a]
            if left[window - a]:
                take((a, window - a), 1 << 62)
            b = np.arange(1, (window - a) // 2 + 1)
            for v in b[(left[b] > 0) & (left[window - a - b] > 0)][::-1].tolist():
                take((a, v, window - a - v), 1 << 62)
            if left[a] == before:
                break
    tried = left.copy()  # lengths that may still start a sequence
    for a in range(window - 1, 0, -1):
        while min(left[a], tried[a]) > 0:
            chosen, room, spare = [a], window - a, left.copy()
            spare[a] -= 1
            while room:
                fit = np.flatnonzero(spare[: room + 1])
                if not len(fit):
                    break
                chosen.append(int(fit[-1]))
                spare[fit[-1]] -= 1
                room -= int(fit[-1])
            if room:
                tried[a] = 0
            else:
                take(tuple(chosen), int(left[a]))
    return out


def _place(segments: dict[int, list]):
    """segments: length -> (first rank, last rank after it, first sequence, offset)."""
    starts = {n: np.array([s[0] for s in v]) for n, v in segments.items()}

    def run(docs: pa.Table, offsets: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        uid, rest, tokens, crc, grp = (docs.column(c).to_numpy() for c in ("uid", "rest", "doc_tokens", "crc", "grp"))
        full, bits = docs.column("full").to_pylist(), docs.column("bits").to_pylist()
        before = dict(zip(offsets.column("rest").to_pylist(), offsets.column("before").to_pylist(), strict=True))
        base, local, out, loose, at_length, rank = (int(grp[0]) + 1) << 40 if len(grp) else 0, 0, [], [], None, 0
        for d in np.lexsort((uid, rest)).tolist():
            n, r = int(tokens[d]), int(rest[d])
            for i, c in enumerate(full[d]):
                out.append((d, i * WINDOW, WINDOW, c, base + local, 0))
                local += 1
            if not r:
                continue
            rank = rank + 1 if r == at_length else before[r]
            at_length, at = r, n - r
            seg = segments.get(r, [])
            i = int(np.searchsorted(starts[r], rank, side="right")) - 1 if seg else -1
            if i >= 0 and rank < seg[i][1]:
                out.append((d, at, r, int(crc[d]), seg[i][2] + rank - seg[i][0], seg[i][3]))
                continue
            own = iter(bits[d])
            for k in range(WINDOW.bit_length() - 2, -1, -1):
                if r >> k & 1:
                    loose.append((1 << k, d, at, next(own)))
                    at += 1 << k
        loose.sort(key=lambda p: -p[0])
        total = sum(p[0] for p in loose)
        first = tail = total - total % WINDOW
        cuts = []
        for k in range(WINDOW.bit_length() - 2, -1, -1):
            if (total % WINDOW) >> k & 1:
                cuts.append(tail)
                tail += 1 << k
        at = 0
        for size, d, start, c in loose:
            if at < first:
                seq, offset = at // WINDOW, at % WINDOW
            else:
                i = int(np.searchsorted(cuts, at, side="right")) - 1
                seq, offset = first // WINDOW + i, at - cuts[i]
            out.append((d, start, size, c, base + local + seq, offset))
            at += size
        d, *rest_of = (np.array(v, np.int64) for v in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 6
        start, length, ids_crc, sequence, offset = rest_of
        columns = [docs.column("doc_id").take(pa.array(d)), start, length, ids_crc, tokens[d], sequence, offset]
        return pa.table(dict(zip((c.split()[0] for c in _PLACED.split(", ")), columns, strict=True)))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are the tokenizer's without special tokens, then EOS; a null or empty text is EOS alone. Each id of each row lies in
    exactly one piece; a sequence holds at most WINDOW ids, gapless from 0, and either fills the window or has a power of
    two of ids, so none is padded. Repeated rows are packed each; ids of any size and null ids are kept; other columns are
    ignored; an empty table gives no rows. ``tokenizer`` is the file's path on every node.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cut_table = common.materialize(rows.mapInArrow(_tokenize(tokenizer), "uid long, doc_id long, doc_tokens long, full array<long>, rest int, crc long, bits array<long>"))
    groups = max(1, math.ceil(cut_table.count() / GROUP_ROWS))
    cut = cut_table.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    counts = common.materialize(cut.groupBy("grp", "rest").count())
    have = np.zeros(WINDOW, np.int64)
    for rest, n in counts.groupBy("rest").agg(F.sum("count")).collect():  # WINDOW rows at most
        have[rest] = n
    have[0] = 0
    segments: dict[int, list] = {}
    used, sequence = np.zeros(WINDOW, np.int64), 0
    for lengths, n in plan(have):
        offset = 0
        for v in lengths:
            segments.setdefault(v, []).append((int(used[v]), int(used[v]) + n, sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    before = F.coalesce(F.sum("count").over(Window.partitionBy("rest").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("grp", "rest", before.alias("before"))
    parts = min(groups, common.exchange_partitions(cut_table))
    left, right = cut.repartition(parts, "grp").groupBy("grp"), offsets.repartition(parts, "grp").groupBy("grp")
    return left.cogroup(right).applyInArrow(_place(segments), _PLACED)
