"""Approximate neighbours by an inverted file: rows are dealt to the nearest of a few centres, a query reads some lists.

Opt-in. Centres are fitted on a bounded sample (``sample`` rows by a hash of the id); every row is indexed. How many lists a
query reads follows from recall measured against exact search within the sample, unless it is given. Written, the rows of a
list are a folder, so that a search reads its lists alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.predicate import flag
from ..sources.files import Files
from .search import knn, knn_join

SAMPLE = 20_000
#: Recall that probes are chosen for; over 0.9 because the sample's neighbours are not the table's.
RECALL = 0.95
#: Neighbours and queries of the sample by which probes are chosen.
NEAR, TRIALS = 10, 500
#: Filters that pass a smaller share of the rows are answered exactly.
SELECTIVE = 0.1


def _orders(centres: np.ndarray, q: np.ndarray, space: str) -> np.ndarray:
    """For each query all lists, nearest first."""
    far = ((centres**2).sum(axis=1)[None, :] - 2 * q @ centres.T) if space == "L2" else -q @ centres.T
    return np.argsort(far, axis=1, kind="stable")


def _read(orders: np.ndarray, sizes: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many lists of its order each query reads: ``probes``, or as many as hold k rows."""
    enough = np.cumsum(sizes[orders], axis=1) >= k
    first = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, orders.shape[1])
    return np.maximum(first, probes)


@dataclass
class InvertedFile:
    rows: DataFrame
    centres: np.ndarray
    space: str
    id_col: str = "doc_id"
    vector_col: str = "vector"
    #: At [p - 1]: the share of true neighbours that the first p lists held, within the sample.
    recalls: np.ndarray = field(default_factory=lambda: np.ones(1))

    def probes(self, recall: float = RECALL) -> int:
        """The fewest lists that found ``recall`` of the neighbours within the sample."""
        return int(np.argmax(self.recalls >= recall - 1e-12)) + 1

    def _plan(self, probes: int | None, where: str, metadata: str | None = None) -> tuple[int, np.ndarray]:
        """Lists to read, and the rows of each list that pass the filter; all lists if it is selective."""
        passing = np.zeros(len(self.centres), np.int64)
        total = 0
        for r in self.rows.groupBy("list_id").agg(F.count("*").alias("n"), F.count_if(flag(self.rows, where, metadata)).alias("p")).collect():
            total += r["n"]
            passing[r["list_id"]] = r["p"]
        wanted = self.probes() if probes is None else probes
        return (len(self.centres) if passing.sum() < SELECTIVE * total else wanted), passing

    def write(self, path: str) -> None:
        """Write the rows as a folder a list, so that a search reads its lists alone, and the centres beside them."""
        self.rows.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/lists")
        known = {"centres": self.centres.tolist(), "space": self.space, "id_col": self.id_col, "vector_col": self.vector_col, "recalls": self.recalls.tolist(), "schema": self.rows.drop("list_id").schema.json()}
        Files(self.rows.sparkSession).write_json(f"{path}/centres.json", known)

    def search(self, query, k: int, probes: int | None = None, where: str = "", keep: list[str] | None = None, metadata: str | None = None, vector_type: str = "FLOAT32") -> DataFrame:
        probes, passing = self._plan(probes, where, metadata)
        orders = _orders(self.centres, np.asarray(query, np.float64)[None, :], self.space) if len(self.centres) > 1 else np.zeros((1, 1), int)
        chosen = orders[0, : _read(orders, passing, probes, k)[0]]
        near = self.rows.where(F.col("list_id").isin([int(c) for c in chosen]))
        return knn(near, query, k, self.space, where, metadata, keep, vector_type, self.id_col, self.vector_col)

    def search_join(self, queries: DataFrame, k: int, probes: int | None = None, where: str = "") -> DataFrame:
        """(query_id, id, distance, rank) for a table of queries (query_id, vector)."""
        probes, passing = self._plan(probes, where)
        centres, space = self.centres, self.space

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                q = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                orders = _orders(centres, q, space) if len(centres) > 1 else np.zeros((len(q), 1), int)
                n = _read(orders, passing, probes, k)
                at = np.repeat(np.arange(len(q)), n)
                own = np.concatenate([o[:m] for o, m in zip(orders, n, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("vector").take(pa.array(at)), pa.array(own, pa.int32())], names=["query_id", "vector", "list_id"])

        dealt = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(lists, "query_id long, vector array<float>, list_id int")
        return knn_join(self.rows, dealt, k, space, where, by="list_id", id_col=self.id_col, vector_col=self.vector_col)


def _sample_recalls(x: np.ndarray, own: np.ndarray, centres: np.ndarray, space: str) -> np.ndarray:
    """At [p - 1]: the share of the nearest NEAR rows, over queries drawn from the sample, that lie in a query's first p lists."""
    q = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
    far = ((x**2).sum(axis=1)[None, :] - 2 * q @ x.T) if space == "L2" else -q @ x.T
    near = np.argsort(far, axis=1, kind="stable")[:, :NEAR]
    place = np.argsort(_orders(centres, q, space), axis=1)  # of each list in each query's order
    places = np.take_along_axis(place, own[near], axis=1)
    return np.cumsum(np.bincount(places.ravel(), minlength=len(centres))) / places.size


def load(spark: SparkSession, path: str) -> InvertedFile:
    """An inverted file that was written."""
    known = Files(spark).read_json(f"{path}/centres.json")
    schema = T.StructType.fromJson(json.loads(known["schema"])).add("list_id", T.IntegerType())
    rows = spark.read.schema(schema).parquet(f"{path}/lists")
    return InvertedFile(rows, np.array(known["centres"]), known["space"], known["id_col"], known["vector_col"], np.array(known["recalls"]))


def build(df: DataFrame, lists: int = 64, space: str = "IP", steps: int = 8, sample: int = SAMPLE, id_col: str = "doc_id", vector_col: str = "vector") -> InvertedFile:
    drawn = df.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    x = np.array([r[vector_col] for r in drawn], np.float64)
    if not len(x):
        return InvertedFile(df.withColumn("list_id", F.lit(0)), np.zeros((1, 1)), space, id_col, vector_col)
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(steps):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(axis=1)
    table = F.array(*(F.struct(vectors.distance("L2", F.col(vector_col), vectors.vector_literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    return InvertedFile(df.withColumn("list_id", F.array_min(table)["i"]), centres, space, id_col, vector_col, _sample_recalls(x, own, centres, space))
