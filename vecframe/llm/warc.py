"""WARC archives written and read as streams, with payloads as a table of chunks.

Writing: each task streams its records into gzip members of archives in the shared folder, under names of its own attempt, and
only the archives of attempts that Spark commits are listed and read; a payload passes in chunks. Reading: a record's payload comes back as rows (record, chunk
number, bytes) that carry the digest and length of the payload so far, so no reader holds a record whole; the last chunk has
the digest of all. Equal payloads are written once: of a group the last page is the response, the others are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, SLICE = 1 << 20, 8 << 10
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Parts over which the pages of one payload are dealt in the join with its group.
SALTS = 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNKS = "page_id long, record_id string, record_type string, refers_to long, chunk long, last boolean, data binary, payload_bytes long, payload_digest string"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def roles(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """(uid, page_id, url, data, lead): lead is the response's (page_id, uid) in groups of equal payloads, else null."""
    common.bounded_batches(pages.sparkSession)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    keyed = rows.withColumn("sha", F.sha1("data")).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    groups = keyed.where(F.length("data") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "uid")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    groups = groups.select(F.col("sha").alias("s"), "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    return keyed.join(groups, (F.col("sha") == F.col("s")) & (F.col("salt") == F.col("t")), "left").select("uid", "page_id", "url", "data", "lead")


def _name(page_id, uid) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{uid}>"


def _header(row: dict, length: int, digest: str, kind: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(row['page_id'], row['uid'])}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if row["url"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(row['lead']['page_id'], row['lead']['uid'])}", f"WARC-Payload-Length: {length}"]
    size = len(_HTTP) + (length if kind == "response" else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _file_system(root)
        task, number, out, records = TaskContext.get(), 0, None, 0
        done: list[tuple[str, int]] = []

        def close():
            out.close()
            done.append((path, records))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path, records = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0
                    out = system.open_output_stream(path, compression=None)
                row = {c: batch.column(c)[i].as_py() for c in ("uid", "page_id", "url", "lead")}
                value = batch.column("data")[i].as_buffer()
                view = memoryview(value) if value is not None else memoryview(b"")
                sha = hashlib.sha1()
                for x in range(0, len(view), CHUNK):
                    sha.update(view[x : x + CHUNK])
                lead = row["lead"]
                kind = "revisit" if lead and lead["uid"] != row["uid"] else "response"
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                pieces = [_header(row, len(view), base64.b32encode(sha.digest()).decode(), kind), _HTTP]
                if kind == "response":
                    pieces += [view[x : x + CHUNK] for x in range(0, len(view), CHUNK)]
                for piece in [*pieces, b"\r\n\r\n"]:
                    out.write(gz.compress(piece))
                out.write(gz.flush())
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return run


def _inflate(stream) -> Iterator[bytes]:
    """Decompressed pieces of a file of gzip members; a member's rest is copied within a slice, not within all that was read."""
    gz = None
    while read := stream.read(CHUNK):
        for x in range(0, len(read), SLICE):
            raw = read[x : x + SLICE]
            while raw:
                gz = gz or zlib.decompressobj(31)
                piece = gz.decompress(raw, CHUNK)
                raw = gz.unconsumed_tail
                if gz.eof:
                    raw, gz = gz.unused_data, None
                if piece:
                    yield piece
    if gz and (rest := gz.flush()):
        yield rest


class Records:
    """The records of one archive, in order, each with its payload as a stream of chunks."""

    def __init__(self, stream):
        self.pieces, self.held = _inflate(stream), b""

    def _more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def _until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        head, _, self.held = self.held.partition(mark)
        return head

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while self.held or self._more():
            lines = self._until(b"\r\n\r\n").decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = dict(line.split(": ", 1) for line in lines[1:])
            before = self._until(b"\r\n\r\n")
            body = self._body(int(head["Content-Length"]) - len(before) - 4)
            yield head, body
            for _ in body:
                pass
            self._until(b"\r\n\r\n")

    def _body(self, left: int) -> Iterator[bytes]:
        while left:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a payload")
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            yield part


def _ids(name: str) -> int | None:
    text = name[1:-1].split(":")[2]
    return int(text) if text else None


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(root)
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for head, body in Records(stream):
                        name, kind = head["WARC-Record-ID"], head["WARC-Type"]
                        refers = _ids(head["WARC-Refers-To"]) if kind == "revisit" else None
                        sha, total, number, last = hashlib.sha1(), 0, 0, b""
                        for chunk in body:
                            if last:
                                rows.append((_ids(name), name, kind, refers, number, False, last, total, base64.b32encode(sha.digest()).decode()))
                                number += 1
                            sha.update(chunk)
                            total += len(chunk)
                            last, held = chunk, held + len(chunk)
                            if held >= 4 * CHUNK and rows:
                                yield out(rows)
                                rows, held = [], 0
                        digest = base64.b32encode(sha.digest()).decode()
                        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            total, digest = int(head["WARC-Payload-Length"]), told
                        elif digest != told:
                            raise ValueError(f"payload of {name} does not match its digest")
                        rows.append((_ids(name), name, kind, refers, number, True, last, total, digest))
                        if len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as gzip WARC archives below the URI ``root`` (shared by all nodes): (path, records) of each archive.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest id (the last such row) is a
    response and the others are revisits. A null payload is empty; null ids are kept; repeated rows are a record each; columns
    other than the two and ``url`` are ignored; an empty table writes nothing.
    """
    system, top = _file_system(root)
    system.create_dir(top, recursive=True)
    return common.materialize(roles(pages, id_col, html_col, least_bytes).mapInArrow(_write(root), "path string, records long"))


def read_archives(files: DataFrame, root: str) -> DataFrame:
    """The chunk table of the archives listed in ``files`` (path): page_id, record_id, record_type, refers_to, chunk (from 0),
    last, data, payload_bytes and payload_digest.

    Length and digest are of the payload up to each chunk, so of all of it at the last; a revisit has one chunk without data
    and the length and digest of the record it refers to. An empty payload has one empty chunk, an empty list gives no rows;
    other columns are ignored; a payload that does not match its digest raises.
    """
    return files.select("path").repartition(max(1, files.count())).mapInArrow(_read(root), _CHUNKS)


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Archives of all ``pages``, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Rows count as in ``write_archives``; the archives are removed when the driver's program ends.
    """
    root = f"{common.shared_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    common.keep_until_exit(pages.sparkSession, root)
    files = write_archives(pages, root, id_col, html_col)
    return read_archives(files, root).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
