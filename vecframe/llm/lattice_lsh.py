"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors at random to eight dimensions and decodes them to the nearest point of the E8 lattice: the
home cell. A vector also looks into the PROBES neighbouring cells nearest to its projection. Two vectors meet in a table if
one's home is among the other's cells; pairs that meet are verified by cosine in double precision.

Equal vectors are one entry with a multiplicity. A cell with more than BLOCK members is dealt into parts, and every two parts
meet in a block of their own, so no task holds a whole cell. Blocks are read twice: first with a sketch of each vector (signs
of random projections), which tells members that can have no partner there, then with the vectors of the others, so that a
vector travels only to blocks where it is likely to link. Links are counted in the blocks, not emitted: a pair counts only in
the first table, and there in the lower cell, in which it meets, which both vectors' cells tell; cells are computed again for
the members with links. A block sends on counts and a spanning forest, both linear in its members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

TABLES, PROBES, SCALE = 8, 8, 1.3
LEAST = 0.95
BLOCK = 2048
#: Bits of a sketch, and standard deviations by which two sketches may differ in more bits than vectors of the least cosine do.
SKETCH, SPREAD = 256, 6.0
_CHUNK = 20_000


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


_SHORT = shortest_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    miss = x[rows] - near[rows]
    worst = np.abs(miss).argmax(axis=1)
    near[rows, worst] += np.where(miss[np.arange(len(rows)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    mult = kernels.mix(np.arange(1, 9, dtype=kernels.U) * kernels.U(2 * table + 1)) | kernels.U(1)
    doubled = np.rint(points * 2).astype(np.int64).view(kernels.U)
    return kernels.mix((doubled * mult).sum(axis=-1, dtype=kernels.U) + kernels.U(table)).view(np.int64)


def cells(units: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES) cell codes: home first."""
    out = np.empty((len(units), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        y = units @ np.random.default_rng(1000 + t).normal(size=(units.shape[1], 8)) * SCALE
        home = decode(y)
        near = np.argpartition(-((y - home) @ _SHORT.T), PROBES, axis=1)[:, :PROBES]
        out[:, t, 0] = _code(home, t)
        out[:, t, 1:] = _code(home[:, None, :] + _SHORT[near], t)
    return out


def sketches(units: np.ndarray) -> np.ndarray:
    """(rows, SKETCH / 64) words of signs of random projections."""
    signs = units @ np.random.default_rng(7).normal(size=(units.shape[1], SKETCH)) >= 0
    return np.packbits(signs, axis=1).view(kernels.U)


def most_apart(least: float) -> int:
    """Bits in which sketches of vectors with cosine ``least`` differ at most, but for a chance of one in 10**9."""
    p = np.arccos(min(1.0, max(-1.0, least))) / np.pi
    return int(np.ceil(SKETCH * p + SPREAD * np.sqrt(SKETCH * p * (1 - p))))


def units_of(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision, the same from the same numbers."""
    units = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    units = units / np.abs(units).max(axis=1, keepdims=True)
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector its sketch and its cells of all tables, in the order of tables, home first."""
    width = TABLES * (1 + PROBES)
    for batch in batches:
        column = batch.column("vec")
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            rows = pa.array(np.flatnonzero(sizes == d))
            units = units_of(column.take(rows), d)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(units) + 1, width, dtype=np.int32)), pa.array(cells(units).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vid").take(rows), pa.array([x.tobytes() for x in sketches(units)]), codes], names=["vid", "sketch", "cells"])


def _canonical(table: int, cell: int, codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs meet here first: in no earlier table, and in no lower cell of this one."""
    out = np.empty(len(i), bool)
    for x in range(0, len(i), _CHUNK):
        a, b = codes[i[x : x + _CHUNK], : table + 1], codes[j[x : x + _CHUNK], : table + 1]
        meet = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
        first = ~meet[:, :table].any(axis=1)
        ha, hb = a[:, table, 0], b[:, table, 0]
        other = np.where(ha == cell, hb, ha)
        both = (hb[:, None] == a[:, table]).any(axis=1) & (ha[:, None] == b[:, table]).any(axis=1) & (ha != hb)
        out[x : x + _CHUNK] = first & ~(both & (other < cell))
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member linked to each, by repeated minima over links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """(cell, tab, lo, hi) and the rows of each block of batches that are sorted by them."""
    at, held = None, []
    for batch in batches:
        for cell, table, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "tab", "lo", "hi", *names)), strict=True):
            key = (cell, table, lo, hi)
            if key != at:
                if len(held) > 1:
                    yield at, held
                at, held = key, []
            held.append(row)
    if len(held) > 1:
        yield at, held


def _likely(least: float):
    """Members of each block whose sketch leaves room for a link with another there."""
    most = most_apart(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            types = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, bool)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, types, strict=True)], names=["vid", "cell", "tab", "lo", "hi", "part", "home"])

        for (cell, table, lo, hi), rows in _by_block(batches, ("vid", "part", "home", "sketch")):
            vid, part, home = (np.array(x) for x in zip(*((r[0], r[1], r[2]) for r in rows), strict=True))
            words = np.frombuffer(b"".join(r[3] for r in rows), kernels.U).reshape(len(rows), -1)
            some = np.zeros(len(rows), bool)
            for x in range(0, len(rows), 256):
                apart = sum(np.bitwise_count(words[x : x + 256, None, w] ^ words[None, :, w]).astype(np.int32) for w in range(words.shape[1]))
                near = (apart <= most) & (home[x : x + 256, None] | home[None, :])
                if lo != hi:
                    near &= part[x : x + 256, None] != part[None, :]
                else:
                    near[np.arange(len(near)), x + np.arange(len(near))] = False
                some[x : x + 256] = near.any(axis=1)
            if some.any():
                n = int(some.sum())
                out.append([vid[some], *(np.full(n, v) for v in (cell, table, lo, hi)), part[some], home[some]])
                if len(out) >= 5000:
                    yield flush()
        if out:
            yield flush()

    return run


def _blocks(least: float):
    def settle(key, rows) -> Iterator[pa.RecordBatch]:
        cell, table, lo, hi = key
        vid, m, home, part = (np.array(x) for x in zip(*((r[0], r[1], r[2], r[3]) for r in rows), strict=True))
        by_size: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by_size.setdefault(len(r[4]), []).append(k)
        for d, at in by_size.items():
            at = np.array(at)
            units = units_of(pa.array([rows[k][4] for k in at]), d)
            h, p, ids, mult = home[at], part[at], vid[at], m[at]
            i, j = np.nonzero(np.triu(units @ units.T >= least, 1))
            ok = h[i] | h[j]
            if lo != hi:
                ok &= p[i] != p[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            linked = np.unique(np.concatenate((i, j)))
            codes = cells(units[linked])
            keep = _canonical(table, cell, codes, np.searchsorted(linked, i), np.searchsorted(linked, j))
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.bincount(i, mult[j], len(at)) + np.bincount(j, mult[i], len(at))
            label = _forest(len(at), i, j)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])], names=["vid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_block(batches, ("vid", "m", "home", "part", "vec")):
            yield from settle(key, rows)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (vec_id = component_id).

    Rows link if their cosine is at least ``least`` and the tables let them meet. Vectors that are null, empty, zero, hold
    null or non-finite numbers, or differ in length link with nothing; a row without links is its own component. Repeated
    rows link with each other. A null id is kept and names no component that has another id. An empty table gives no rows.
    """
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    table = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("own"), vec.alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = table.withColumn("k1", F.when(fine, F.xxhash64("vec"))).withColumn("k2", F.when(fine, F.xxhash64(F.lit(7), F.col("vec"))))
    groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"), F.first("own").alias("vec"))
    held = common.numbered(groups, "vid")
    members = common.materialize(held.select("vid", "vec").mapInArrow(_members, "vid long, sketch binary, cells array<long>"))
    parts = common.exchange_partitions(members)
    wide = 1 + PROBES
    each = members.select("vid", "sketch", F.posexplode("cells").alias("at", "cell"))
    each = each.select("vid", "sketch", "cell", F.floor(F.col("at") / wide).cast("int").alias("tab"), (F.col("at") % wide == 0).alias("home"))
    shared = each.groupBy("cell", "tab").agg(F.count("*").alias("n"), F.max("home").alias("h")).where("n > 1 and h").select("cell", "tab", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    meet = each.join(shared, ["cell", "tab"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    meet = meet.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("vid", "cell", "tab", "home", "part", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"), "sketch")
    key = ("cell", "tab", "lo", "hi")
    likely = common.materialize(meet.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_likely(least), "vid long, cell long, tab int, lo int, hi int, part int, home boolean"))
    found = likely.join(held.select("vid", "m", "vec"), "vid").repartition(parts, *key).sortWithinPartitions(*key).select(*key, "vid", "m", "home", "part", "vec").mapInArrow(_blocks(least), "vid long, links long, root long")
    found = common.materialize(found.groupBy("vid", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("vid").agg(F.sum("links").alias("links"))
    roots = common.components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    named = held.select("k1", "k2", "vid", "m", "low").join(counts, "vid", "left").join(roots.withColumnRenamed("v", "vid"), "vid", "left")
    named = common.materialize(named.select("k1", "k2", "m", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "vid").alias("root")))
    common.discard(members, likely, found, roots)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("entries"))
    inside = common.joined_by_share(named, lows, ["root"], "entries", named.count())
    inside = common.materialize(inside.select("k1", "k2", "m", (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id"))
    usable = rows.where("k1 is not null").select("vec_id", "k1", "k2")
    out = common.joined_by_share(usable, inside, ["k1", "k2"], "m", usable.count()).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("k1 is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    common.discard(named, held)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
