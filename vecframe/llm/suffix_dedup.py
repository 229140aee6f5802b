"""Removal of repeated substrings of at least WIDTH bytes, exact over the whole table.

Routing: every WIDTH-byte window has an anchor, the least hash among its K-byte grams. A maximal run of windows with one
anchor, with the bytes they cover, is a stretch; equal windows have equal anchors, so only stretches of one anchor can share a
window. Equal stretches (128-bit BLAKE2b of their bytes) are combined in the batch and again by anchor, so that a passage in a
third of all documents travels once a batch. A stretch that occurs once under an anchor of its own has no equal window.

Deciding: for every other anchor one example of each stretch is fetched, and a suffix array is built over the block of them,
in text order, with a second copy of each stretch that occurs more than once at the end (a copy's ranks are its example's, so
they are computed once). Previous and next smaller text
positions in suffix order, with the least common prefix on the way to them, give the longest previous factor of every window:
it reaches WIDTH exactly where an earlier equal window exists. The mirrored array (next greater positions) tells later ones.
Copies of a stretch beyond the second share the second's verdict.

An anchor with very many different stretches would be an unbounded block; its windows are compared by 128-bit hashes instead,
which split without a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

WIDTH, K = 200, 64
#: Windows in a stretch at most; longer runs (periodic text) are split.
RUN = 1024
#: Stretches gathered before a batch is combined.
BATCH_STRETCHES = 500_000
#: Different stretches of one anchor above which window hashes are used.
HOT_STRETCHES = 2048
#: Bytes over which one suffix array is built, unless one group is larger (HOT_STRETCHES bounds it).
BLOCK_BYTES = 400_000
# Spans and asks are joined with their texts by sort and merge at every size: what they weigh tells little of what they become.
#: Added to the length of a stretch whose anchor recurs inside it (periodic text): it can hold equal windows itself.
SELF = 1 << 24
_U = kernels.U
_FIELDS = [("anchor", _U), ("s1", _U), ("s2", _U), ("uid", np.int64), ("pos", np.int32), ("len", np.int32), ("cnt", np.int32)]
_SENT = "kind int, bucket int, " + ", ".join(f"{n} binary" for n, _ in _FIELDS)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """Minimum or maximum of every w neighbours."""
    span = 1
    while span * 2 <= w:
        x = best(x[: len(x) - span], x[span:])
        span *= 2
    return best(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit BLAKE2b of each [begin, end)."""
    view, one = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    both = np.frombuffer(b"".join([one(view[i:j], digest_size=16).digest() for i, j in zip(begin.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, stretch hash in two halves, start, length, with SELF where the anchor recurs) of one run of bytes."""
    n, w = len(data), WIDTH - K + 1
    if n < WIDTH:
        return tuple(np.empty(0, t) for t in (_U, _U, _U, np.int64, np.int64))
    sums, back = kernels.prefix_hash(data), kernels.powers(n + 1)[1]
    grams = kernels.mix((sums[K:] - sums[:-K]) * back[: n - K + 1])
    least = _sliding(grams, w, np.minimum)
    widest = _sliding(np.concatenate((np.zeros(w - 1, _U), least, np.zeros(w - 1, _U))), w, np.maximum)
    anchors = np.flatnonzero(grams == widest)
    values = grams[anchors]
    again = np.flatnonzero((values[1:] == values[:-1]) & (np.diff(anchors) <= w))
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(cut, len(least)))
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        cut = np.repeat(cut, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        size = np.diff(np.append(cut, len(least)))
    end = cut + size - 1 + WIDTH
    length = end - cut
    if len(again):
        low = np.searchsorted(cut, np.maximum(anchors[again + 1] - w + 1, 0), side="right") - 1
        high = np.searchsorted(cut, anchors[again], side="right") - 1
        for value, i, j in zip(values[again], low, high, strict=True):
            inner = np.arange(min(i, j), j + 1)
            length[inner[(least[cut[inner]] == value) & (length[inner] < SELF)]] += SELF
    return least[cut], *digests(data, cut, end), cut, length


def _batch_of(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays.values()], names=list(arrays))


def _combine(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted by (anchor, stretch, uid, position); which rows are first of their stretch; occurrences of each stretch."""
    order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    first = np.ones(len(order), bool)
    first[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
    at = np.flatnonzero(first)
    return cols, first, np.add.reduceat(cols[6], at) if len(at) else cols[6]


def _send(buckets: int):
    names = ["kind", "bucket", *[n for n, _ in _FIELDS]]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * len(_FIELDS)]

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        cols, first, total = _combine([np.concatenate(x) for x in zip(*held, strict=True)])
        done = ~first
        rows = [(1, 0, b"", b"", b"", cols[3][done].tobytes(), cols[4][done].tobytes(), (cols[5][done] & (SELF - 1)).tobytes(), b"")] if done.any() else []
        cols = [c[first] for c in cols[:6]] + [total.astype(np.int32)]
        b = (cols[0] % _U(buckets)).astype(np.int32)
        order = np.lexsort((cols[4], cols[3], b))
        b, cols = b[order], [c[order] for c in cols]
        cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
        rows += [(0, int(b[i]), *(c[i:j].astype(t).tobytes() for c, (_, t) in zip(cols, _FIELDS, strict=True))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in range(0, len(rows), 32):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 32], strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, starts = kernels.flat(batch.column("data"))
            for uid, lo, hi in zip(batch.column("uid").to_pylist(), starts[:-1], starts[1:], strict=True):
                for x in range(int(lo), int(hi), kernels.SLICE_BYTES):
                    part = data[x : min(x + kernels.SLICE_BYTES + WIDTH - 1, hi)]
                    if len(part) < WIDTH:
                        continue
                    anchor, s1, s2, at, length = stretches(part)
                    held.append((anchor, s1, s2, np.full(len(at), uid), (at + (x - lo)).astype(np.int32), length.astype(np.int32), np.ones(len(at), np.int32)))
                    size += len(at)
                if size >= BATCH_STRETCHES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        held.clear()
        kernels.release()

    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, pos, length in zip(batch.column("uid").to_pylist(), batch.column("pos").to_pylist(), batch.column("len").to_pylist(), strict=True):
            pos = np.frombuffer(pos, np.int32).astype(np.int64)
            yield _batch_of({"uid": np.frombuffer(uid, np.int64), "s": pos, "e": pos + np.frombuffer(length, np.int32)})


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: further copies of stretches (kind 1) and an example of each that blocks must decide (kind 2)."""

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.frombuffer(b"".join(x), t) for x, (_, t) in zip(zip(*held, strict=True), _FIELDS, strict=True)]
        cols, first, total = _combine(cols)
        at = np.flatnonzero(first)
        anchor = cols[0][at]
        group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        kinds = np.bincount(group)[group]
        open_ = np.flatnonzero((kinds > 1) | (total > 1) | (cols[5][at] >= SELF))
        for kind, rows in ((1, np.flatnonzero(~first)), (2, at[open_])):
            for i in range(0, len(rows), 100_000):
                x, pick = rows[i : i + 100_000], open_[i : i + 100_000]
                none = np.zeros(len(x), np.int64)
                yield _batch_of({
                    "kind": np.full(len(x), kind, np.int32), "uid": cols[3][x], "pos": cols[4][x].astype(np.int64), "len": (cols[5][x] & (SELF - 1)).astype(np.int64), "anchor": cols[0][x].view(np.int64),
                    "cnt": total[pick].astype(np.int64) if kind == 2 else none, "nd": kinds[pick].astype(np.int64) if kind == 2 else none,
                })

    at, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *[n for n, _ in _FIELDS])), strict=True):
            if bucket != at and held:
                yield from settle(held)
                held = []
            at = bucket
            held.append(row)
    if held:
        yield from settle(held)
    held.clear()
    kernels.release()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked stretches of each row."""
    for batch in batches:
        for uid, data, asks in zip(batch.column("uid").to_pylist(), batch.column("data"), batch.column("asks").to_pylist(), strict=True):
            data = data.as_buffer()
            for i in range(0, len(asks), 10_000):
                part = asks[i : i + 10_000]
                yield _batch_of({
                    "anchor": np.array([x["anchor"] for x in part]), "uid": np.full(len(part), uid), "pos": np.array([x["pos"] for x in part]), "cnt": np.array([x["cnt"] for x in part]), "nd": np.array([x["nd"] for x in part]),
                    "bytes": [data.slice(x["pos"], x["len"]).to_pybytes() for x in part],
                })
    kernels.release()


def suffix_ranks(text: np.ndarray, starts: np.ndarray, depth: int = WIDTH) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Dense ranks of all positions by their first 8, 16, 32 ... bytes, by prefix doubling, and of ``starts`` by ``depth``
    bytes; past the end counts as zeros."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(_U)
    key = np.zeros(n, _U)
    for i in range(8):
        key |= padded[i : i + n] << _U(56 - 8 * i)
    have, out = 8, {8: np.unique(key, return_inverse=True)[1]}
    while have * 2 < depth:
        rest = np.zeros(n, np.int64)
        rest[: max(0, n - have)] = out[have][have:] + 1
        out[have * 2] = np.unique(out[have] * (n + 1) + rest, return_inverse=True)[1]
        have *= 2
    rank = out[have]
    return out, np.unique(rank[starts] * (n + 1) + rank[starts + (depth - have)], return_inverse=True)[1]


def common_prefixes(text: np.ndarray, ranks: dict[int, np.ndarray], whole: np.ndarray, order: np.ndarray) -> np.ndarray:
    """At each place of ``order`` (positions) the length, at most WIDTH, of the prefix common with the place before; 0 at the
    first. ``whole``: the places' ranks by WIDTH bytes."""
    a, b, last = order[:-1], order[1:], len(text) - 1  # places past the end are met with WIDTH in common only
    out = np.where(whole[1:] == whole[:-1], WIDTH, 0)
    some = np.flatnonzero(out == 0)
    a, b, part = a[some], b[some], np.zeros(len(some), np.int64)
    for size in sorted(ranks, reverse=True):
        part += size * (ranks[size][np.minimum(a + part, last)] == ranks[size][np.minimum(b + part, last)])
    still = np.ones(len(a), bool)
    for _ in range(7):
        still &= text[np.minimum(a + part, last)] == text[np.minimum(b + part, last)]
        part += still
    out[some] = np.minimum(part, WIDTH - 1)
    return np.concatenate(([0], out))


def nearest_smaller(values: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """For each place the least of ``prefixes`` on the way back to the nearest smaller value; 0 where there is none.

    All places step back together, each over the whole stretch that the place it has reached has passed already.
    """
    back, least = np.arange(len(values)) - 1, prefixes.copy()
    live = np.flatnonzero(values[back] > values)
    live = live[back[live] >= 0]
    while len(live):
        at = back[live]
        least[live] = np.minimum(least[live], least[at])
        back[live] = back[at]
        live = live[back[live] >= 0]
        live = live[values[back[live]] > values[live]]
    least[back < 0] = 0
    return least


def longest_factors(order: np.ndarray, prefixes: np.ndarray, later: bool = False) -> np.ndarray:
    """Of each place in suffix order the longest factor, at most WIDTH, that starts at an earlier text position too (or later)."""
    values = -order if later else order
    turned = np.concatenate(([0], prefixes[:0:-1]))
    return np.maximum(nearest_smaller(values, prefixes), nearest_smaller(values[::-1], turned)[::-1])


def repeated_windows(parts: list[bytes], counts: list[int], keep_first: bool) -> list[np.ndarray]:
    """For each part the window starts to remove. Parts stand in text order; a part occurs counts[i] times in the table."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    windows = lengths - WIDTH + 1
    first = np.cumsum(windows) - windows
    at = kernels.ranges(np.cumsum(lengths) - lengths, windows)
    ranks, rank = suffix_ranks(text, at)
    again = kernels.ranges(first, windows)[np.repeat(np.array(counts) > 1, windows)]  # windows of second copies
    place = np.concatenate((at, len(text) + at[again]))
    rank, at = np.concatenate((rank, rank[again])), np.concatenate((at, at[again]))
    suffixes = np.argsort(rank, kind="stable")  # equal windows by place
    prefixes = common_prefixes(text, ranks, rank[suffixes], at[suffixes])
    gone = longest_factors(place[suffixes], prefixes) >= WIDTH
    if not keep_first:
        gone |= longest_factors(place[suffixes], prefixes, later=True) >= WIDTH
    hit = np.zeros(len(at), bool)
    hit[suffixes] = gone
    if not hit[len(at) - len(again) :].all():
        raise AssertionError("a second copy has windows without an earlier match")
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(first.tolist(), windows.tolist(), strict=True)]


def spans(starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal (start, end) covered by windows at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.concatenate(([True], starts[1:] > starts[:-1] + width))
    return starts[new], np.append(starts[:-1][new[1:]], starts[-1]) + width


def _group(keep_first: bool):
    def settle(held: list) -> Iterator[pa.RecordBatch]:
        found = repeated_windows([h[3] for h in held], [h[2] for h in held], keep_first)
        out = [[], [], []]
        for (uid, pos, _, _), at in zip(held, found, strict=True):
            s, e = spans(at)
            for o, v in zip(out, (np.full(len(s), uid), s + pos, e + pos), strict=True):
                o.append(v)
        yield _batch_of(dict(zip(("uid", "s", "e"), (np.concatenate(o).astype(np.int64) for o in out), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "uid", "pos", "cnt", "bytes")), strict=True):
                if anchor != at and size >= BLOCK_BYTES:
                    yield from settle(held)
                    held, size = [], 0
                at = anchor
                held.append(row)
                size += len(row[3])
        if held:
            yield from settle(held)
        held.clear()
        kernels.release()

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, pos, cnt, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "pos", "cnt", "bytes")), strict=True):
            at = np.arange(len(text) - WIDTH + 1)
            w1, w2 = digests(np.frombuffer(text, np.uint8), at, at + WIDTH)
            yield _batch_of({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "uid": np.full(len(at), uid), "at": pos + at, "cnt": np.full(len(at), cnt)})


def _hot_spans(texts: DataFrame, keep_first: bool) -> DataFrame:
    """(uid, s, e) of the repeated windows of stretches (uid, pos, cnt, bytes), by hashes of windows."""
    windows = common.materialize(texts.mapInArrow(_windows, "w1 long, w2 long, uid long, at long, cnt long"))
    many = windows.groupBy("w1", "w2").agg(F.sum("cnt").alias("total"), F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("lead")).where("total > 1").select("w1", "w2", "n", "lead")
    hot = common.joined_by_share(windows, many, ["w1", "w2"], "n", windows.count())
    if keep_first:
        hot = hot.where((F.col("uid") != F.col("lead.uid")) | (F.col("at") != F.col("lead.at")))
    return hot.select("uid", F.col("at").alias("s"), (F.col("at") + WIDTH).alias("e"))


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, s, e) sorted by uid and s, those that touch joined to one."""
    at = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "s", "e")), strict=True):
            if at and at[0] == row[0] and row[1] <= at[2]:
                at = (at[0], at[1], max(at[2], row[2]))
            else:
                out += [at] if at else []
                at = row
        if out:
            yield _batch_of(dict(zip(("uid", "s", "e"), (np.array(x) for x in zip(*out, strict=True)), strict=True)))
    if at:
        yield _batch_of({k: np.array([v]) for k, v in zip(("uid", "s", "e"), at, strict=True)})


def removals(rows: DataFrame, parts: int, keep_first: bool) -> DataFrame:
    """(uid, spans: array<struct<s, e>>) for the rows (uid, data) that lose bytes; the table is written."""
    rows = rows.select("uid", "data")
    sent = common.materialize(rows.mapInArrow(_send(parts), _SENT))
    local = sent.where("kind = 1").select("uid", "pos", "len").mapInArrow(_verdicts, "uid long, s long, e long")
    settled = sent.where("kind = 0").select("bucket", *[n for n, _ in _FIELDS]).repartition(parts, "bucket").sortWithinPartitions("bucket")
    settled = common.materialize(settled.mapInArrow(_resolve, "kind int, uid long, pos long, len long, anchor long, cnt long, nd long"))
    asks = settled.where("kind = 2").groupBy("uid").agg(F.collect_list(F.struct("anchor", "pos", "len", "cnt", "nd")).alias("asks"))
    texts = common.materialize(rows.join(asks.hint("merge"), "uid").select("uid", "data", "asks").mapInArrow(_fetch, "anchor long, uid long, pos long, cnt long, nd long, bytes binary"))
    by_suffix = texts.where(F.col("nd") <= HOT_STRETCHES).select("anchor", "uid", "pos", "cnt", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "uid", "pos").mapInArrow(_group(keep_first), "uid long, s long, e long")
    hot = _hot_spans(texts.where(F.col("nd") > HOT_STRETCHES).select("uid", "pos", "cnt", "bytes"), keep_first)
    whole = settled.where("kind = 1").select("uid", F.col("pos").alias("s"), (F.col("pos") + F.col("len")).alias("e"))
    found = local.union(whole).union(by_suffix).union(hot).repartition(parts, "uid").sortWithinPartitions("uid", "s").mapInArrow(_merged_spans, "uid long, s long, e long")
    out = common.materialize(found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")))
    common.discard(sent, settled, texts)
    return out


def _cuts(found: list | None) -> list[tuple[int, int]]:
    return [(x["s"], x["e"]) for x in (() if found is None else found)]


def _kept(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    if not cuts:
        return data
    ends = [0, *[e for _, e in cuts]]
    return b"".join(data[a:b] for a, b in zip(ends, [*[s for s, _ in cuts], len(data)], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, digests = [], [], [], []
        for data, found in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            cuts = _cuts(found)
            sizes.append(len(data))
            removed.append(sum(e - s for s, e in cuts))
            runs.append(len(cuts))
            digests.append(hashlib.sha256(_kept(data, cuts)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a WIDTH-byte string that covers it starts at another place too, in the same text or another;
    ``keep_first`` leaves the occurrence that comes first in the table. Null texts count as empty and lose nothing, nor do
    texts under WIDTH bytes. Repeated rows repeat each other's bytes. Null ids are kept; other columns are ignored; an
    empty table gives no rows.
    """
    rows = common.numbered(common.texts(docs, id_col, text_col), "uid")
    found = removals(rows, common.exchange_partitions(rows), keep_first)
    return rows.join(found.hint("merge"), "uid", "left").select("doc_id", "data", "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = True) -> DataFrame:
    """``docs`` with repeated bytes cut out of the text; every row and column stays, a character cut in part goes whole.

    A null text stays null; a text that is all repeats becomes empty. A column ``n_chars`` is set to the new length. Repeated
    rows keep the bytes of the first in the table; other columns, whatever their names, are kept; an empty table gives no rows.
    """
    uid = common.fresh(docs, "uid")
    found = common.fresh(docs, "spans")

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None else _kept(t.encode(), _cuts(s)).decode(errors="ignore"))

    table = common.numbered(docs, uid)
    gone = removals(common.texts(table, id_col, text_col, F.col(uid).alias("uid")), common.exchange_partitions(table), keep_first).select(F.col("uid").alias(uid), F.col("spans").alias(found))
    out = table.join(gone.hint("merge"), uid, "left")
    out = out.withColumn(text_col, F.when(F.col(found).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(found))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast("long")))
    return out.select(*docs.columns)
