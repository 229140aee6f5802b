"""Collections of documents: a snapshot and an operation log as Parquet, and a catalog of those loaded.

A collection's folder has ``settings.json``, ``current.json``, ``snapshot/v=N``, ``log/<base>-<last>-<name>`` and, if built,
``index/<name>``. ``current.json`` tells the version of the snapshot, the last sequence number folded into it, what the last
save or compaction replaced, the last batch of each stream and the index. Files are never changed: a save writes the next
snapshot and swaps ``current.json``; what it replaced is removed by the save or compaction after it, so frames made before
stay readable until then, and a crash leaves a readable state. One writer a collection.
"""

from __future__ import annotations

import logging
import re
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values, vectors
from ..functions.predicate import matching
from ..operators import ann, facets, search
from . import oplog
from .files import Files
from .requests import AddDocuments, Settings

log = logging.getLogger(__name__)
#: Bytes of log above which an addition after a deletion compacts it, and up to which its ids are broadcast.
COMPACT_BYTES, BROADCAST_BYTES = 64 << 20, 64 << 20
_DELETION, _STREAM = "delete", re.compile(r"-stream([0-9a-f]+)_(\d+)$")


class NotFound(LookupError):
    """No such collection or document."""


class AlreadyExists(ValueError):
    """The collection is loaded already."""


class DamagedLog(RuntimeError):
    """The log has an entry with a wrong checksum; what follows it is not read."""


class Collection:
    def __init__(self, spark: SparkSession, path: str, settings: Settings, damaged: bool = False):
        self.spark, self.path, self.settings = spark, path, settings
        self.files = Files(spark)
        self.damaged = damaged

    def _current(self) -> dict:
        return {"replaced": {"version": 0, "parts": []}, "streams": {}, "index": None} | self.files.read_json(f"{self.path}/current.json")

    def _parts(self) -> list[str]:
        """The log parts after the snapshot that nothing has replaced."""
        now = self._current()
        names = [n for n in self.files.names(f"{self.path}/log") if not n.startswith(("_", ".")) and self.files.exists(f"{self.path}/log/{n}/_SUCCESS")]
        return [n for n in names if int(n.split("-")[1]) > now["folded"] and n not in now["replaced"]["parts"]]

    @property
    def deletes(self) -> bool:
        """Whether the log has deletions since the last save or compaction."""
        return any(n.split("-")[2].startswith(_DELETION) for n in self._parts())

    def stream_batch(self, stream: str) -> int:
        """The last batch of a stream that was written, -1 if none."""
        return self._streams().get(stream, -1)

    def _streams(self) -> dict[str, int]:
        found = dict(self._current()["streams"])
        for n in self._parts():
            if m := _STREAM.search(n):
                found[m[1]] = max(found.get(m[1], -1), int(m[2]))
        return found

    def entries(self) -> DataFrame:
        """The intact entries after the snapshot."""
        names = self._parts()
        rows = self.spark.read.schema(oplog.ENTRY).parquet(*(f"{self.path}/log/{n}" for n in names)) if names else self.spark.createDataFrame([], oplog.ENTRY)
        return oplog.intact(rows).where(F.col("seq") > self._current()["folded"])

    def snapshot(self) -> DataFrame:
        version = self._current()["version"]
        if not version:
            return self.spark.createDataFrame([], values.DOCUMENT)
        return self.spark.read.schema(values.DOCUMENT).parquet(f"{self.path}/snapshot/v={version}")

    def documents(self) -> DataFrame:
        """The live documents (doc_id, vector, metadata): the log is folded by itself and replaces rows of the snapshot."""
        if not self._parts():
            return self.snapshot()
        last = oplog.last_states(self.entries().drop("crc"))
        return self._without(self.snapshot(), last).unionByName(last.where(F.col("op") == oplog.ADD).select(*values.DOCUMENT.names))

    def _without(self, rows: DataFrame, last: DataFrame) -> DataFrame:
        """``rows`` but those of documents that the log has; small logs' ids are broadcast, so the rows do not move."""
        ids = last.select("doc_id")
        return rows.join(F.broadcast(ids) if self.log_bytes() <= BROADCAST_BYTES else ids, "doc_id", "left_anti")

    def _next(self) -> int:
        """The first unused sequence number: from the names of the log parts, which carry their last."""
        lasts = [int(n.split("-")[1]) for n in self.files.names(f"{self.path}/log") if n[0].isdigit()]
        return max([self._current()["folded"], *lasts]) + 1

    def append(self, entries: DataFrame, n: int, name: str | None = None) -> None:
        """Write one log part of ``n`` entries (op, doc_id, vector, metadata, at: from 0)."""
        if self.damaged:
            raise DamagedLog(f"{self.path}: entries after the damage would never be read; see repair()")
        base = self._next()
        rows = oplog.sealed(entries.withColumn("seq", F.col("at") + base))
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{base:019d}-{base + n - 1:019d}-{name or uuid.uuid4().hex}")

    def add(self, request: AddDocuments) -> None:
        for v in request.vectors:
            if len(v) != self.settings.dimension:
                raise ValueError(f"vectors have {self.settings.dimension} numbers, not {len(v)}")
        rows = [(at, *row) for at, row in enumerate(request.rows())]
        if rows:
            frame = self.spark.createDataFrame(rows, "at long, doc_id long, vector array<float>, metadata map<string,struct<k:tinyint,l:bigint,d:double,s:string>>")
            self.append(frame.select("at", F.lit(oplog.ADD).alias("op"), "doc_id", vectors.quantized(F.col("vector"), self.settings.vectorType).alias("vector"), "metadata"), len(rows))
            self._compact_if_large()

    def _compact_if_large(self) -> None:
        if self.log_bytes() > COMPACT_BYTES and self.deletes:
            self.compact()

    def add_frame(self, documents: DataFrame, name: str | None = None) -> None:
        """Add a DataFrame (doc_id, vector, metadata), in the order of the ids; of duplicate ids the last row stays."""
        dim = self.settings.dimension
        bad = (F.size("vector") != dim) | F.col("vector").isNull() | F.col("doc_id").isNull() | ~F.col("doc_id").between(0, values.LARGEST_ID)
        doc_id = F.when(bad, F.raise_error(F.lit(f"a document needs an id and {dim} numbers"))).otherwise(F.col("doc_id"))
        n = documents.count()
        if n:
            rows = documents.select(F.monotonically_increasing_id().alias("u"), doc_id.cast("long").alias("doc_id"), vectors.quantized(F.col("vector"), self.settings.vectorType).alias("vector"), "metadata")
            rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("vector", "metadata"), "u").alias("d")).select(F.col("doc_id").alias("at"), F.lit(oplog.ADD).alias("op"), "doc_id", "d.vector", "d.metadata")
            self.append(rows, values.LARGEST_ID + 1, name)
            self._compact_if_large()

    def delete(self, ids: list[int]) -> None:
        """Delete documents; unknown ids are recorded too and do no harm."""
        if ids:
            frame = self.spark.createDataFrame(list(enumerate(map(int, ids))), "at long, doc_id long")
            empty = [F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(values.METADATA).alias("metadata")]
            self.append(frame.select("at", F.lit(oplog.DELETE).alias("op"), "doc_id", *empty), len(ids), _DELETION + uuid.uuid4().hex)

    def get(self, doc_id: int) -> dict:
        row = self.documents().where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise NotFound(f"document {doc_id}")
        return {"id": row["doc_id"], "vector": list(row["vector"]), "metadata": {k: values.untagged(v) for k, v in (row["metadata"] or {}).items()}}

    def get_many(self, ids: list[int]) -> DataFrame:
        """One row a given id, in their order: place, doc_id, vector, metadata; the last two null if there is no such document."""
        return search.by_places(self.documents(), ids)

    def search(self, query: list[float], k: int, where: str = "", return_metadata: bool = False, approximate: bool = False) -> DataFrame:
        """The k nearest documents (doc_id, distance[, metadata]); exact, or by the index if ``approximate`` and one is built.

        With the index, filters that pass under a tenth of the rows are answered exactly, documents written since it was built
        are searched beside it, and deleted ones are left out of its lists.
        """
        if len(query) != self.settings.dimension:
            raise ValueError(f"the query needs {self.settings.dimension} numbers")
        keep, s = ["metadata"] if return_metadata else None, self.settings
        built = self._current()["index"] if approximate else None
        if built is None:
            return search.knn(self.documents(), query, k, s.spaceType, where, "metadata", keep, s.vectorType)
        index, changed = ann.load(self.spark, built["path"]), self._changed(built)
        if changed is None:
            return index.search(query, k, where=where, keep=keep, metadata="metadata", vector_type=s.vectorType)
        index.rows = self._without(index.rows, changed)
        new = search.knn(changed.where(F.col("op") == oplog.ADD), query, k, s.spaceType, where, "metadata", keep, s.vectorType)
        return index.search(query, k, where=where, keep=keep, metadata="metadata", vector_type=s.vectorType).unionByName(new).orderBy("distance", "doc_id").limit(k)

    def _changed(self, built: dict) -> DataFrame | None:
        """The last entry of each document that was written since the index was built; None if none was."""
        if self._next() - 1 <= built["last"]:
            return None
        return oplog.last_states(self.entries().where(F.col("seq") > built["last"]).drop("crc"))

    def build_index(self, lists: int = 64) -> None:
        """Write the live documents as an inverted file (see ``ann``), dealt to folders by list; a save keeps it no longer."""
        last, path = self._next() - 1, f"{self.path}/index/{uuid.uuid4().hex}"
        ann.build(self.documents(), lists, self.settings.spaceType).write(path)
        now = self._current()
        old = now["index"]
        self.files.write_json(f"{self.path}/current.json", now | {"index": {"path": path, "last": last}})
        if old:
            self.files.remove(old["path"])

    def filter(self, where: str) -> DataFrame:
        return matching(self.documents(), where, "metadata")

    def facets(self, where: str = "") -> tuple[DataFrame, DataFrame]:
        rows = self.filter(where)
        return facets.facet_counts(rows, "metadata"), facets.facet_ranges(rows, "metadata")

    def log_bytes(self) -> int:
        return sum(self.files.size(f"{self.path}/log/{n}") for n in self._parts())

    def is_damaged(self) -> bool:
        """Whether an entry of the log has a wrong checksum (one scan)."""
        names = self._parts()
        if not names:
            return False
        rows = self.spark.read.schema(oplog.ENTRY).parquet(*(f"{self.path}/log/{n}" for n in names))
        return not rows.where(F.coalesce(F.col("crc") != oplog.checksum(), F.lit(True))).isEmpty()

    def repair(self) -> None:
        """Give up the entries from the first damaged one on, so that the collection can be written again."""
        self.damaged = False
        self.save()

    def _replace(self, now: dict, old_version: int, parts: list[str], **changes) -> None:
        """Swap ``current.json``, then remove what the replacement before this one replaced."""
        replaced = {"version": old_version, "parts": parts}
        self.files.write_json(f"{self.path}/current.json", now | {"streams": self._streams(), "replaced": replaced} | changes)
        for name in now["replaced"]["parts"]:
            self.files.remove(f"{self.path}/log/{name}")
        if now["replaced"]["version"]:
            self.files.remove(f"{self.path}/snapshot/v={now['replaced']['version']}")

    def save(self) -> None:
        """Write the live documents as the next snapshot; the log folded into it, the snapshot before and the index go."""
        if self.damaged:
            raise DamagedLog(f"{self.path}: a save would drop the entries after the damage; see repair()")
        now, parts = self._current(), self._parts()
        folded, version = self._next() - 1, now["version"] + 1
        self.files.remove(f"{self.path}/snapshot/v={version}")
        self.documents().write.parquet(f"{self.path}/snapshot/v={version}")
        self._replace(now, now["version"], parts, version=version, folded=folded, index=None)
        if now["index"]:
            self.files.remove(now["index"]["path"])

    def compact(self) -> None:
        """Rewrite the log with the last entry of each document; deletions stay for documents of the snapshot or the index."""
        now, parts = self._current(), self._parts()
        if not parts or self.damaged:
            return
        last = max(int(n.split("-")[1]) for n in parts)
        held = self.snapshot().select("doc_id")
        if now["index"]:
            held = held.union(ann.load(self.spark, now["index"]["path"]).rows.select("doc_id"))
        rows = oplog.sealed(oplog.compacted(self.entries().drop("crc"), held))
        rows.write.parquet(f"{self.path}/log/{0:019d}-{last:019d}-{uuid.uuid4().hex}")
        self._replace(now, 0, parts)

    def status(self) -> dict:
        current = self.documents().count()
        entries = self.entries()
        known = self.snapshot().select("doc_id").union(entries.where(F.col("op") == oplog.ADD).select("doc_id")).distinct().count()
        return {"indexName": self.settings.indexName, "resizing": False, "replayingWal": False, "bufferedWrites": 0, "currentElements": known, "maxElements": known, "deletedElements": known - current, "logBytes": self.log_bytes()}


class Engine:
    """The catalog of loaded collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.loaded: dict[str, Collection] = {}

    def health(self) -> str:
        return "OK"

    def list(self) -> list[str]:
        return sorted(self.loaded)

    def collection(self, name: str) -> Collection:
        if name not in self.loaded:
            raise NotFound(f"collection {name}")
        return self.loaded[name]

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a name for a collection: {name!r}")
        return f"{self.root}/{name}"

    def create(self, settings: Settings) -> Collection:
        name = settings.indexName
        if name in self.loaded:
            raise AlreadyExists(name)
        path = self._path(name)
        self.files.remove(path)
        self.files.write_json(f"{path}/settings.json", asdict(settings))
        self.files.write_json(f"{path}/current.json", {"version": 0, "folded": -1})
        self.loaded[name] = Collection(self.spark, path, settings)
        log.info("created %s", name)
        return self.loaded[name]

    def load(self, name: str) -> Collection:
        if name in self.loaded:
            raise AlreadyExists(name)
        path = self._path(name)
        if not self.files.exists(f"{path}/settings.json"):
            raise NotFound(f"collection {name}")
        collection = Collection(self.spark, path, Settings(**self.files.read_json(f"{path}/settings.json")))
        collection.damaged = collection.is_damaged()
        if collection.damaged:
            log.error("%s has a damaged log entry; it can be read up to there, and written after repair()", name)
        self.loaded[name] = collection
        return collection

    def save(self, name: str) -> None:
        self.collection(name).save()

    def drop(self, name: str) -> None:
        """Forget a loaded collection; its files stay."""
        self.collection(name)
        del self.loaded[name]

    def drop_files(self, name: str) -> None:
        if name in self.loaded:
            raise AlreadyExists(f"{name} is loaded")
        self.files.remove(self._path(name))

    def status(self, name: str) -> dict:
        return self.collection(name).status()
