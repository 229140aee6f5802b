"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from ..sources.scratch import keep_until_exit, remove, shared_root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``discard`` or, for tables that a lazy result still reads, until the driver's program ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    keep_until_exit(spark, path)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written", None):
            remove(path)


#: Rows that Spark hands to Python at once: texts can be long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows where it is larger, so that a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


#: Bytes of a stored table for which an explicit exchange has one partition, and partitions at least.
PARTITION_BYTES, PARTITIONS = 8 << 20, 64


def exchange_partitions(table: DataFrame) -> int:
    """Partitions for an explicit exchange: follows the bytes of a table of ``materialize``, never under the session's setting
    or PARTITIONS, so that what meets in one Python worker stays small."""
    spark = table.sparkSession
    size = Files(spark).size(table._written) if hasattr(table, "_written") else 0
    return max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``name``, written once: number and row stay together whatever later jobs' scans look like."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The columns ``more``, doc_id and data: the id and the UTF-8 bytes of the text (null: empty)."""
    bounded_batches(docs.sparkSession)
    return docs.select(*more, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))


#: Keys that hold more than one row in so many are joined by broadcast, so there are at most so many of them.
HEAVY = 1000


def joined_by_share(rows: DataFrame, named: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``named`` on ``keys`` (unique in ``named``; ``count``: rows with the key), no task holding a heavy key.

    Keys with over ``total`` / HEAVY rows are fewer than HEAVY, so they are broadcast; the rest is joined by shuffle. Rows
    without their key in ``named`` are left out.
    """
    heavy = F.col(count) * HEAVY > total
    few, rest = named.where(heavy).drop(count), named.where(~heavy).drop(count)
    light = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(light.join(rest, keys))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (v, root), root the smallest vertex; vertices without edges are absent.

    Each round maps a vertex to its smallest neighbour, contracts the graph and repeats until no edge is left. Rounds are
    written to the shared folder, and the tables of the round before removed; minima are combined before each shuffle, so a
    hub costs no more than its edges.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        old = (edges, labels, step if labels is not None else None)
        up = step.select(F.col("v").alias("root"), F.col("root").alias("up"))
        labels = step if labels is None else materialize(labels.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root")))
        ta, tb = step.select(F.col("v").alias("a"), F.col("root").alias("ra")), step.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = materialize(edges.join(ta, "a").join(tb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        discard(*old)
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
