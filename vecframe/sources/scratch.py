"""A shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

from .files import Files

#: Folders to remove when the driver's program ends, with the session that wrote them.
_FOLDERS: dict[str, SparkSession] = {}


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Remove the folder ``path`` when the driver's program ends."""
    _FOLDERS[path] = spark


def remove(path: str) -> None:
    """Remove a folder of ``keep_until_exit`` now."""
    spark = _FOLDERS.pop(path, None)
    if spark:
        Files(spark).remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_FOLDERS):
        with contextlib.suppress(Exception):  # the session may be gone
            remove(path)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder already set.

    Where neither is set, a temporary folder is made and registered if the session runs on this machine alone (tests); on a
    cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vecframe-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(held.get()).rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver's program ends."""
    path = f"{shared_root(spark)}/vecframe-{uuid.uuid4().hex}"
    keep_until_exit(spark, path)
    return path
