"""Stored results: small derived tables that many queries read are written once and read back until they are too old.

A stored table is named by what it is and by the size and time of the files it is made from, so changed input makes a
new one.  It lies in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a stored result is good for.
TTL = 3600.0

_made: list[tuple[SparkSession, str]] = []
_known: dict[tuple, tuple[float, str, object]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/millrace-store"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it is removed when the process ends."""
    path = f"{shared_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                fs, at = file_system(spark, path)
                fs.delete(at, True)
        except Exception:  # the session may be gone at exit
            return


def file_system(spark: SparkSession, path: str):
    """The JVM's file system and path object of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def signature(spark: SparkSession, path: str) -> tuple:
    """What changes when a file or folder does."""
    fs, at = file_system(spark, path)
    status = fs.getFileStatus(at)
    files = [status] if status.isFile() else list(fs.listStatus(at))
    return (path, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def stored(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], ttl: float = TTL, clock: Callable[[], float] = time.time) -> DataFrame:
    """make() as a written table: made once for each application, name and state of the inputs, and again after ttl."""
    key = (spark.sparkContext.applicationId, name, *(signature(spark, p) for p in inputs))
    have = _known.get(key)
    if have is not None and clock() - have[0] < ttl and _exists(spark, have[1]):
        return spark.read.schema(have[2]).parquet(have[1])
    df = make()
    path = new_path(spark, name)
    df.coalesce(1).write.parquet(path)
    _known[key] = (clock(), path, df.schema)
    if have is not None and _exists(spark, have[1]):
        fs, at = file_system(spark, have[1])
        fs.delete(at, True)
    return spark.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)
