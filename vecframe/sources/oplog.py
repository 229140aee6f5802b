"""The operation log: rows (seq, op, doc_id, vector, metadata, crc) that fold to the last state of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values

ADD, DELETE = "ADD", "DELETE"
ENTRY = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *values.DOCUMENT.fields, T.StructField("crc", T.LongType())])


def checksum() -> Column:
    """crc32 of an entry's other columns as JSON; map entries in the order of their names."""
    sorted_entries = F.array_sort(F.map_entries(F.coalesce(F.col("metadata"), F.expr("cast(map() as map<string,struct<k:tinyint,l:bigint,d:double,s:string>>)"))))
    return F.crc32(F.to_json(F.struct("seq", "op", "doc_id", "vector", sorted_entries.alias("m"))).cast("binary"))


def sealed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("crc", checksum()).select(*ENTRY.names)


def intact(entries: DataFrame) -> DataFrame:
    """The entries before the first one whose checksum is wrong."""
    first_bad = entries.where(F.coalesce(F.col("crc") != checksum(), F.lit(True))).agg(F.min("seq").alias("bad"))
    return entries.join(F.broadcast(first_bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).select(*ENTRY.names)  # one row


def last_states(entries: DataFrame) -> DataFrame:
    """The last entry of each document, additions and deletions."""
    rest = [c for c in entries.columns if c != "doc_id"]
    return entries.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("doc_id", *(F.col(f"e.{c}").alias(c) for c in rest))


def live(entries: DataFrame) -> DataFrame:
    """Documents whose last entry is an addition."""
    return last_states(entries).where(F.col("op") == ADD)


def compacted(entries: DataFrame, snapshot_ids: DataFrame | None = None) -> DataFrame:
    """The shortest log with the same effect: last additions, and last deletions of documents that a snapshot may hold.

    Without ``snapshot_ids`` a deletion stays if the log has no addition of its document before it, else only if listed.
    """
    last = last_states(entries)
    if snapshot_ids is not None:
        gone = last.where(F.col("op") == DELETE).join(snapshot_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        added = entries.where(F.col("op") == ADD).select("doc_id").distinct()
        gone = last.where(F.col("op") == DELETE).join(added, "doc_id", "left_anti")
    return last.where(F.col("op") == ADD).unionByName(gone)
