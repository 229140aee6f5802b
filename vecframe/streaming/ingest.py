"""Streams of documents into a collection: one log part a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Add the documents (doc_id, vector, metadata) of ``stream``. A batch that is repeated after a failure is written once.

    Batches are known by the id that the checkpoint gives the query, so several streams may feed one collection and a new
    checkpoint starts anew; the last batch of each is kept over saves, so a repeated one revives no document deleted since.
    """
    metadata = f"{checkpoint.rstrip('/')}/metadata"

    def add(batch: DataFrame, number: int) -> None:
        name = collection.files.read_json(metadata)["id"].replace("-", "")
        if number > collection.stream_batch(name):
            collection.add_frame(batch, f"stream{name}_{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
