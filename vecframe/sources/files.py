"""Small control files on whatever file system Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read_json(self, path: str) -> dict:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write_json(self, path: str, value: dict) -> None:
        """Whole or not at all: a file under another name, renamed onto the old one."""
        fs, p = self._at(path)
        temporary = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(fs.makeQualified(temporary), fs.makeQualified(p), array)
