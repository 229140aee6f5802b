"""Exact n-gram Jaccard self-join as a grouped prefix join.

1. Documents with equal shingle sets form one class (128 bits of set hash, from two independent hashes of every word). Every class orders its shingles by hash and sends
   a long prefix: with overlap floor a = ceil(0.75 n), a prefix of n - a + l shingles of two similar classes shares at least
   min(l_x, l_y) of them. Shingles met in two classes of the same batch are settled there (only a marker travels), so a
   shingle in a third of all documents costs one row a batch. A class stays active if enough of its prefix is shared.
2. Active classes are sorted by each of a few min-hashes; of the neighbours in these orders each class tries the most alike
   by signature, and the pairs are verified: copies with small edits fall into components after a number of checks linear in
   the documents.
3. The exact join runs between components: shingles are ordered by (crosses components, frequency, hash); those that stay in
   one component fill prefixes without being sent. Classes with equal prefixes and sizes are one group; group pairs that
   share a prefix shingle and pass the size filter are expanded to members and verified. No pair of similar classes in
   different components can be missed; pairs inside a component cannot change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

NUM, DEN = 75, 100
#: Shingles gathered before a batch is combined.
BATCH_SHINGLES = 400_000
#: Active classes up to which their keys are broadcast (20 bytes each); above it the join is by shuffle.
BROADCAST_ROWS = 1_000_000
SHARE = 12
#: 64-bit words of the bitmap that bounds an overlap from above: a power of two.
BITMAP = 8
_WORDS = [f"w{k}" for k in range(BITMAP)]
#: Min-hashes of a class: all in its signature, the first KEYS also as sort keys; a row is compared with BACK rows before it.
SIGNATURE, KEYS, BACK, PROMISING, ROUNDS = 64, 8, 6, 0.65, 2
_ROW = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def least_overlap(n):
    return -(-n * NUM // DEN)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_keys(tokens: np.ndarray, checks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each row's set, order-free, from the two hashes of its shingles; the first is never 0."""
    n = np.diff(offsets).astype(kernels.U)
    sums = (np.concatenate((np.zeros(1, kernels.U), np.cumsum(kernels.mix(x + kernels.U(1)), dtype=kernels.U))) for x in (tokens, checks))
    one, two = (kernels.mix(x[offsets[1:]] - x[offsets[:-1]] + n * kernels.U(0xC2B2AE3D27D4EB4F)) for x in sums)
    return one | kernels.U(1), two


def _prefixes(buckets: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        uid, ids, null = (np.concatenate([h[k] for h in held]) for k in range(3))
        tokens, checks = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        n = np.concatenate([np.diff(h[5]) for h in held])
        offsets = np.concatenate(([0], np.cumsum(n)))
        cls, check = class_keys(tokens, checks, offsets)
        cls[n == 0] = 0
        _, once = np.unique(cls, return_index=True)
        once = once[n[once] > 0]
        size = n[once]
        length = np.minimum(size, size - least_overlap(size) + size // SHARE + 1)
        begin = offsets[once]
        total = int(length.sum())
        shift = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) if total else np.empty(0, np.int64)
        tok = tokens[np.arange(total) + shift] if total else np.empty(0, kernels.U)
        owner = np.repeat(np.arange(len(once)), length)
        order = np.argsort(tok, kind="stable")
        tok, owner = tok[order], owner[order]
        new = np.concatenate(([True], tok[1:] != tok[:-1])) if total else np.empty(0, bool)
        run = np.cumsum(new) - 1
        many = (np.bincount(run) > 1)[run] if total else new
        shared = np.zeros(len(cls), np.int32)
        shared[once] = np.bincount(owner[many], minlength=len(once))
        key = np.where(many, kernels.U(0), cls[once][owner]) if total else tok
        send = ~many | new
        tok, key = tok[send], key[send]
        b = (tok % kernels.U(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        b, tok, key = b[order], tok[order], key[order]
        cuts = np.concatenate((np.flatnonzero(np.diff(b, prepend=-1)), [len(b)]))
        rows = [(0, int(b[i]), tok[i:j].tobytes(), key[i:j].tobytes(), b"", b"", b"", b"", b"") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        rows.append((1, 0, uid.tobytes(), cls.tobytes(), n.astype(np.int32).tobytes(), ids.tobytes(), null.tobytes(), shared.tobytes(), check.tobytes()))
        names = ["kind", "bucket", *"abcdefg"]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 64], strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = kernels.flat(batch.column("data"))
            ids = batch.column("doc_id")
            uid, known, null = batch.column("uid").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for lo, hi in kernels.row_slices(starts):
                tokens, checks, offsets = kernels.shingles(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
                held.append((uid[lo:hi], known[lo:hi], null[lo:hi], tokens, checks, offsets))
                size += len(tokens)
                if size >= BATCH_SHINGLES:
                    yield from flush(held)
                    held, size = [], 0
                    kernels.release()
        if held:
            yield from flush(held)
        kernels.release()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, cls, n, ids, null, shared, check in zip(*(batch.column(k).to_pylist() for k in "abcdefg"), strict=True):
            whole = (np.frombuffer(x, t) for x, t in ((n, np.int32), (cls, np.int64), (check, np.int64), (shared, np.int32)))
            columns = [pa.array(np.frombuffer(uid, np.int64)), pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool)), *map(pa.array, whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "k1", "k2", "shared"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: how many prefix shingles of each class occur in another class too."""

    def settle(toks: list, keys: list) -> Iterator[pa.RecordBatch]:
        tok, key = np.frombuffer(b"".join(toks), kernels.U), np.frombuffer(b"".join(keys), kernels.U)
        order = np.lexsort((key, tok))
        tok, key = tok[order], key[order]
        first = np.concatenate(([True], (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])))
        tok, key = tok[first], key[first]
        run = np.cumsum(np.concatenate(([True], tok[1:] != tok[:-1]))) - 1
        many = (np.bincount(run) > 1)[run] & (key != 0)
        cls, n = np.unique(key[many], return_counts=True)
        if len(cls):
            yield pa.RecordBatch.from_arrays([pa.array(_i64(cls)), pa.array(n.astype(np.int64))], names=["k1", "cnt"])

    at, toks, keys = None, [], []
    for batch in batches:
        for bucket, a, b in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if bucket != at and toks:
                yield from settle(toks, keys)
                toks, keys = [], []
            at = bucket
            toks.append(a)
            keys.append(b)
    if toks:
        yield from settle(toks, keys)
    kernels.release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = kernels.mix(np.arange(1, SIGNATURE + 1, dtype=kernels.U)) | kernels.U(1)
    for batch in (b.slice(lo, 200) for b in batches for lo in range(0, b.num_rows, 200)):
        data, starts = kernels.flat(batch.column("data"))
        tokens, _, offsets = kernels.shingles(data, starts)
        if not len(tokens):
            continue
        least = np.stack([np.minimum.reduceat(tokens * m, offsets[:-1]) for m in odd], axis=1)
        n = batch.num_rows
        at = (tokens >> kernels.U(64 - BITMAP.bit_length() - 5)).astype(np.int64)
        bit = kernels.U(1) << (at & 63).astype(kernels.U)
        words = [_i64(np.bitwise_or.reduceat(np.where(at >> 6 == k, bit, kernels.U(0)), offsets[:-1])) for k in range(BITMAP)]
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, ROUNDS * KEYS * n + 1, ROUNDS * KEYS, dtype=np.int32)), pa.array(_i64(np.ascontiguousarray(least[:, : ROUNDS * KEYS])).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("cls"), batch.column("n"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_i64(tokens))), keys, pa.array([x.tobytes() for x in (least >> kernels.U(40)).astype(np.uint16)]), *map(pa.array, words)],
            names=["cls", "n", "tokens", "least", "sig", *_WORDS],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key number, key, next key): promising pairs of a row with the rows just before it."""
    last = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "h", "cls", "n", "comp")] + [np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SIGNATURE)]
        if last is not None:
            rows = [np.concatenate(x) for x in zip(last, rows, strict=True)]
        i, h, cls, n, comp, sig = rows
        for back in range(1, BACK + 1):
            if len(i) <= back:
                continue
            same = (i[back:] == i[:-back]) & (h[back:] == h[:-back]) & (comp[back:] != comp[:-back]) & (DEN * np.minimum(n[back:], n[:-back]) >= NUM * np.maximum(n[back:], n[:-back]))
            at = np.flatnonzero(same) + back
            alike = (sig[at] == sig[at - back]).mean(axis=1) if len(at) else np.empty(0)
            at, alike = at[alike >= PROMISING], alike[alike >= PROMISING]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[at - back]), pa.array(alike)], names=["a", "b", "alike"])
        last = [x[-BACK:] for x in rows]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets pass 100 * intersection >= 75 * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    ok = both * (NUM + DEN) >= (F.size("ta") + F.size("tb")) * NUM
    return pairs.select("a", "b").join(right, "b").join(left, "a").where(ok).select("a", "b")


def similar_classes(texts: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (uid, doc_id, data): their rows (uid, doc_id, n, k1, k2) and the classes of equal sets (k1, k2, m, low, first,
    root); rows without shingles have n 0 and no class.

    ``m`` is the number of rows, ``low`` the smallest doc_id, ``first`` the row of smallest (doc_id, uid); classes of one
    component share ``root``, and only classes with links have one.
    """
    sent = texts.mapInArrow(_prefixes(parts), _ROW)  # read twice: the shingles of a prefix take more room than time
    rows = common.materialize(sent.where("kind = 1").select(*"abcdefg").mapInArrow(_decode, "uid long, doc_id long, n int, k1 long, k2 long, shared int"))
    counts = sent.where("kind = 0").select("bucket", "a", "b").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "k1 long, cnt long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid"))["uid"].alias("first")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), F.min("uid").alias("cls"), F.min("doc_id").alias("low"), first, F.count("*").alias("m"))
    classes = common.materialize(classes.join(counts.groupBy("k1").agg(F.sum("cnt").alias("cnt")), "k1", "left"))
    least = F.floor((F.ceil(F.col("n") * NUM / DEN)) / SHARE) + 1
    active = common.materialize(classes.where(F.col("shared") + F.coalesce("cnt", F.lit(0)) >= least).select("cls", "n", F.col("cls").alias("uid")))
    roots = linked_classes(texts, active, parts)
    named = common.materialize(classes.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("k1", "k2", "m", "low", "first", "root"))
    common.discard(classes, active, roots)
    return rows, named


def linked_classes(texts: DataFrame, active: DataFrame, parts: int) -> DataFrame:
    """Components (v, root) of the classes ``active`` (cls, n, uid: a row of it); classes without links are absent."""
    key = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    sets = common.materialize(texts.select("uid", "data").join(key, "uid").select("cls", "n", "data").mapInArrow(_sets, "cls long, n int, tokens array<long>, least array<long>, sig binary, " + ", ".join(f"{w} long" for w in _WORDS)))

    # the most alike neighbours of another component, in the order of each key
    part, links, tables = sets.select(F.col("cls").alias("v"), F.col("cls").alias("root")).limit(0), None, []
    for r in range(ROUNDS):
        now = sets.select("cls", "n", "sig", F.slice("least", r * KEYS + 1, KEYS).alias("least")).join(part.withColumnRenamed("v", "cls"), "cls", "left")
        keyed = now.select("cls", "n", "sig", F.coalesce("root", "cls").alias("comp"), "least", F.posexplode("least").alias("i", "h")).select("i", "h", F.expr(f"element_at(least, cast((i + 1) % {KEYS} + 1 as int))").alias("g"), "cls", "n", "comp", "sig")
        near = keyed.repartitionByRange(parts, "i", "h", "g", "cls").sortWithinPartitions("i", "h", "g", "cls").select("i", "h", "cls", "n", "comp", "sig").mapInArrow(_neighbours, "a long, b long, alike double")
        best = near.union(near.select(F.col("b"), F.col("a"), "alike")).groupBy("a").agg(F.max(F.struct("alike", "b")).alias("m1"), F.max_by("b", F.struct(F.xxhash64("b"), "alike")).alias("m2"))
        near = best.select("a", F.explode(F.array("m1.b", "m2")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = common.materialize(verified(near, sets))
        links = found if links is None else links.union(found)
        common.discard(part)
        part = common.components(links)
        tables.append(found)
    comp = sets.select("cls", "n", "tokens", *_WORDS).join(part.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("comp"), "tokens", F.array(*_WORDS).alias("words"))

    # the exact join between components
    tokens = comp.select("cls", "n", "comp", F.explode("tokens").alias("tok"))
    crossing = tokens.groupBy("tok").agg(F.count("*").alias("freq"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("tok").alias("t"), "freq")
    mine = tokens.join(crossing, F.col("tok") == F.col("t")).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("freq", "tok"))).alias("cross")).join(comp.select("cls", "n", "comp", "words"), "cls")
    take = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1 - (F.col("n") - F.size("cross"))
    mine = mine.withColumn("take", take.cast("int")).where("take > 0").select("cls", "n", "comp", *(F.col("words")[k].alias(w) for k, w in enumerate(_WORDS)), F.expr("transform(slice(cross, 1, take), x -> x.tok)").alias("prefix"), (F.col("n") - F.size("cross")).alias("own"))
    mine = common.materialize(mine.withColumn("grp", F.xxhash64("n", "own", "prefix")))
    groups = mine.groupBy("grp").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("prefix").alias("prefix"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *(F.bit_and(w).alias(f"all_{w}") for w in _WORDS), *(F.bit_or(w).alias(f"any_{w}") for w in _WORDS))
    bits = [f"{x}_{w}" for x in ("all", "any") for w in _WORDS]
    listed = groups.select("grp", "n", "own", "lo", "hi", *bits, F.posexplode("prefix").alias("i", "tok")).select("tok", "grp", "n", "lo", "hi", *bits, (F.col("n") - F.col("own") - F.col("i")).alias("left"))
    l1, l2 = (listed.select("tok", F.col("grp").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("left").alias(f"l{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"), *(F.col(x).alias(f"{x}{k}") for x in bits)) for k in "ab")
    apart = (F.col("loa") != F.col("hib")) | (F.col("hia") != F.col("lob"))  # not all of one component
    room = (NUM + DEN) * F.least("la", "lb") >= NUM * (F.col("na") + F.col("nb"))  # overlap still possible from this shingle on
    lost = [sum((F.bit_count(F.col(f"all_{w}{x}").bitwiseAND(F.bitwise_not(F.col(f"any_{w}{y}")))) for w in _WORDS), F.lit(0)) for x, y in ("ab", "ba")]
    most = F.least(F.col("na") - lost[0], F.col("nb") - lost[1])  # a bit of one set that the other lacks is a shingle that it lacks
    fits = (NUM + DEN) * most >= NUM * (F.col("na") + F.col("nb"))
    meet = l1.join(l2, (l1.tok == l2.tok) & (F.col("ga") <= F.col("gb")) & apart & room & fits & (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)).select("ga", "gb").distinct()
    m1, m2 = (mine.select(F.col("grp").alias(f"g{k}"), F.col("cls").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
    rest = meet.join(m1, "ga").join(m2, "gb").where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = common.materialize(verified(rest, sets))
    roots = common.components(links.union(more)) if not more.isEmpty() else part
    common.discard(sets, mine, more, *tables, part if roots is not part else None)
    return roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A set is the distinct five-word shingles of a text (see ``kernels.shingles``); two rows link when
    100 * intersection >= 75 * union. ``component_id`` is the smallest doc_id reachable by links. Null and empty texts and
    texts of white space have no shingles and are alone. A null doc_id is kept and never names a component that has another
    id. Repeated rows are rows of one component. An empty table gives no rows; columns other than the two are ignored.
    """
    table = common.numbered(common.texts(docs, id_col, text_col), "uid")
    rows, classes = similar_classes(table, common.exchange_partitions(table))
    common.discard(table)
    linked = classes.where("root is not null")
    named = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"))
    inside = common.joined_by_share(linked.select("k1", "k2", "m", "root"), named, ["root"], "classes", linked.count())
    named = inside.select("k1", "k2", "m", "component_id").union(classes.where("root is null").select("k1", "k2", "m", "low"))
    some = rows.where("n > 0")
    out = common.joined_by_share(some, common.materialize(named), ["k1", "k2"], "m", some.count())
    columns = ("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return out.select(*columns, "component_id").union(rows.where("n = 0").select(*columns, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest (doc_id, position) stays.

    Rows, ids and texts count as in ``jaccard_components``; rows without words stay; all columns are kept as they are.
    """
    uid = common.fresh(docs, "uid")
    table = common.numbered(docs, uid)
    rows, classes = similar_classes(common.texts(table, id_col, text_col, F.col(uid).alias("uid")), common.exchange_partitions(table))
    linked = classes.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("x"), "low", "first"))["first"].alias(uid))
    kept = linked.select(uid).union(classes.where("root is null").select("first")).union(rows.where("n = 0").select("uid"))
    return table.join(kept, uid, "left_semi").drop(uid)
