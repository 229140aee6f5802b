"""Nearest neighbours: one query by expressions, many by matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..functions.predicate import matching

#: Bytes of query vectors that a task holds at once; more queries are answered in blocks.
QUERY_BYTES = 32 << 20
#: Distances that a task of ``knn_batch`` computes at once.
DISTANCES = 4_000_000
#: Rows of a packed chunk of a table, of queries and of rows; a task multiplies one of each at a time.
QUERY_CHUNK, ROW_CHUNK = 1024, 2048
#: Decimals by which ``knn_join`` ranks, so that equal vectors tie and their ids decide.
DECIMALS = 9


def usable(df: DataFrame, vector_col: str, dimension: int) -> DataFrame:
    """The rows whose vector has ``dimension`` numbers and no null."""
    return df.where((F.size(vector_col) == dimension) & ~F.exists(vector_col, lambda x: x.isNull()))


def knn(df: DataFrame, query, k: int, space: str = "IP", where: str = "", metadata: str | None = None, keep: list[str] | None = None, vector_type: str = "FLOAT32", id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """The k nearest rows that pass the filter, as (id, distance, keep...), ascending by distance and id.

    The filter is applied before any distance, and each task keeps k rows. Vectors of the table are taken as stored; the
    query is rounded to ``vector_type`` like them. Rows whose vector is null, holds null or has another length are no hits.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q = vectors.vector_literal(vectors.quantized_list(query, vector_type))
    rows = usable(matching(df, where, metadata), vector_col, len(query)).select(id_col, vectors.distance(space, F.col(vector_col), q).alias("distance"), *(keep or []))
    return rows.orderBy("distance", id_col).limit(k)


def _nearest(space: str, k: int, ids: np.ndarray, queries: np.ndarray, id_col: str, vector_col: str):
    norms, step = (queries**2).sum(axis=1), max(1, DISTANCES // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.empty((len(ids), 0))
        best_i = np.empty((len(ids), 0), np.int64)
        for batch in batches:
            column = batch.column(vector_col)
            if not len(column):
                continue
            whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            own = batch.column(id_col).to_numpy()
            for lo in range(0, len(own), step):  # so that a matrix of distances stays small
                x = whole[lo : lo + step].astype(np.float64)
                dots = queries @ x.T
                d = 1.0 - dots if space == "IP" else norms[:, None] - 2 * dots + (x**2).sum(axis=1)[None, :]
                d = np.concatenate((best_d, d), axis=1)
                i = np.concatenate((best_i, np.broadcast_to(own[lo : lo + step], (len(ids), len(x)))), axis=1)
                if d.shape[1] > k:
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                    width = int((d <= kth[:, None]).sum(axis=1).max())
                    pick = np.argpartition(d, min(width, d.shape[1] - 1), axis=1)[:, :width]
                    d, i = np.take_along_axis(d, pick, 1), np.take_along_axis(i, pick, 1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        n = best_d.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(np.maximum(best_d, 0.0).ravel() if space == "L2" else best_d.ravel())], names=["query_id", id_col, "distance"])

    return run


def knn_batch(df: DataFrame, queries: list[tuple[int, list[float]]], k: int, space: str = "IP", where: str = "", metadata: str | None = None, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of every query, rank from 1 by distance and id."""
    if space not in vectors.SPACES:
        raise ValueError(f"space must be one of {vectors.SPACES}")
    rows = matching(df, where, metadata).select(id_col, vector_col)
    rows = usable(rows, vector_col, len(queries[0][1])) if queries else rows
    schema = f"query_id long, {id_col} long, distance double"
    per = max(1, QUERY_BYTES // max(1, 8 * len(queries[0][1]))) if queries else 1
    found = None
    for lo in range(0, len(queries), per):
        part = queries[lo : lo + per]
        block = rows.mapInArrow(_nearest(space, k, np.array([q for q, _ in part], np.int64), np.array([v for _, v in part], np.float64), id_col, vector_col), schema)
        found = block if found is None else found.union(block)
    found = found if found is not None else df.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(df: DataFrame, size: int, id_col: str, vector_col: str, by: list[str], names: tuple[str, str]) -> DataFrame:
    """(by..., ids, values): the rows as chunks of at most ``size``, each of one value of ``by``, as the bytes of their arrays."""
    ids, flat = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def row(key):
            i, x = (np.concatenate(part) for part in zip(*held.pop(key), strict=True))
            columns = [pa.array([v], pa.int32()) for v in key] + [pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*by, ids, flat])

        for batch in batches:
            if not len(batch):
                continue
            i = batch.column(id_col).to_numpy()
            x = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(i), -1)
            keys = batch.column(by[0]).to_numpy() if by else np.zeros(len(i), np.int32)
            for key in np.unique(keys):
                own = np.flatnonzero(keys == key)
                at = (int(key),) if by else ()
                for lo in range(0, len(own), size):
                    part = own[lo : lo + size]
                    if at in held and sum(len(a) for a, _ in held[at]) + len(part) > size:
                        yield row(at)
                    held.setdefault(at, []).append((i[part], x[part]))
        for key in list(held):
            yield row(key)

    return df.select(id_col, vector_col, *by).mapInArrow(run, ", ".join([*(f"{b} int" for b in by), f"{ids} binary", f"{flat} binary"]))


def _nearest_of_chunks(space: str, k: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None  # ids, vectors of the queries at hand; of the best of each so far the rounded distances, ids and distances

        def out():
            queries, _, near, i, d = own
            keep = i >= 0
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, keep.sum(axis=1))), pa.array(i[keep]), pa.array(d[keep]), pa.array(near[keep])], names=["query_id", id_col, "distance", "near"])

        for batch in batches:
            for qi, qv, ri, rv in zip(*(batch.column(c) for c in ("q_ids", "q_values", "r_ids", "r_values")), strict=True):
                queries, ids = np.frombuffer(qi.as_py(), np.int64), np.frombuffer(ri.as_py(), np.int64)
                if own is None or not np.array_equal(own[0], queries):
                    if own is not None:
                        yield out()
                    q = np.frombuffer(qv.as_py(), np.float32).astype(np.float64).reshape(len(queries), -1)
                    own = (queries, q, np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64), np.zeros((len(queries), k)))
                x = np.frombuffer(rv.as_py(), np.float32).astype(np.float64).reshape(len(ids), -1)
                _, q, best, best_i, best_d = own
                dots = q @ x.T
                d = 1.0 - dots if space == "IP" else np.maximum((q**2).sum(axis=1)[:, None] - 2 * dots + (x**2).sum(axis=1)[None, :], 0.0)
                rounded = np.round(d, DECIMALS)
                for r in range(len(queries)):
                    near = np.flatnonzero(rounded[r] <= best[r, -1])
                    if len(near) > k:
                        near = near[rounded[r, near] <= np.partition(rounded[r, near], k - 1)[k - 1]]
                    if len(near):
                        both = [np.concatenate(x) for x in ((best[r], rounded[r, near]), (best_i[r], ids[near]), (best_d[r], d[r, near]))]
                        order = np.lexsort((both[1], both[0]))[:k]
                        best[r], best_i[r], best_d[r] = (x[order] for x in both)
        if own is not None:
            yield out()

    return run


def knn_join(df: DataFrame, queries: DataFrame, k: int, space: str = "IP", where: str = "", metadata: str | None = None, by: str | None = None, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """As ``knn_batch``, but the queries are a table too, (query_id, vector), however many: none is collected.

    Both sides are packed into chunks and every pair of chunks is multiplied, or with ``by`` the pairs of equal ``by``. Ranks
    are by distance to ``DECIMALS`` places, then by id.
    """
    if space not in vectors.SPACES:
        raise ValueError(f"space must be one of {vectors.SPACES}")
    if k < 1:
        raise ValueError("k must be positive")
    keys = [by] if by else []
    one = queries.select(F.size("vector").alias("d")).where("d > 0").first()
    dimension = one["d"] if one else 0
    queries = usable(queries, "vector", dimension)
    rows = _packed(usable(matching(df, where, metadata), vector_col, dimension), ROW_CHUNK, id_col, vector_col, keys, ("r_ids", "r_values"))
    asked = _packed(queries, QUERY_CHUNK, "query_id", "vector", keys, ("q_ids", "q_values"))
    pairs = asked.join(rows, by) if by else asked.crossJoin(rows)
    found = pairs.select("q_ids", "q_values", "r_ids", "r_values").mapInArrow(_nearest_of_chunks(space, k, id_col), f"query_id long, {id_col} long, distance double, near double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("near", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("near")


def by_ids(df: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The rows of the given ids, as many as there are."""
    return df.where(F.col(id_col).isin(ids))


def by_places(df: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """One row a given id, in their order: place (from 0), id and the other columns, which are null if no row has it."""
    asked = df.sparkSession.createDataFrame(list(enumerate(map(int, ids))), f"place long, {id_col} long")
    rows = df.join(F.broadcast(asked.select(id_col).distinct()), id_col, "left_semi")  # a request's ids
    return asked.join(rows, id_col, "left").select("place", id_col, *(c for c in df.columns if c != id_col)).orderBy("place")


def responses(hits: DataFrame, metadata: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row (response): the hits as a JSON object of hits, distances and, if asked, metadatas in rank order."""
    from ..functions.values import metadata_to_json

    entry = [F.col("distance"), F.col(id_col)] + ([F.coalesce(metadata_to_json(F.col(metadata)), F.lit("null")).alias("m")] if metadata else [])
    one = hits.agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("h"))  # k rows
    text = [F.lit('{"hits":'), F.to_json(F.col(f"h.{id_col}")), F.lit(',"distances":'), F.to_json(F.col("h.distance"))]
    text += [F.lit(',"metadatas":['), F.array_join(F.col("h.m"), ","), F.lit("]")] if metadata else []
    return one.select(F.concat(*text, F.lit("}")).alias("response"))
