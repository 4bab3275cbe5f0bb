"""A folder that driver and executors share, for tables and files between steps.

The place is the cluster's ``spark.checkpoint.dir``; only where that is unset and the master is local
does a fresh folder under the driver's temp folder stand in for it. What a run leaves there goes when
the driver ends; tables that later steps don't read go earlier.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        made = tempfile.mkdtemp(prefix="skein-")
        _fallback.append(f"file://{made}")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _fallback[0]


class Workspace:
    """Names and materialises intermediate tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/skein-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_forget, self.uri)

    def table(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        """Write df as Parquet and return the reread table: lineage ends here, and a lost executor
        costs a reread instead of a recomputation."""
        self._n += 1
        path = f"{self.uri}/{self._n:03d}-{name}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.uri}/{self._n:03d}-{name}"

    def drop(self, table: DataFrame) -> None:
        """Delete the files of a table() that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            self.clear(folder)

    def clear(self, folder: str) -> None:
        """Delete a folder of this workspace, if it's there."""
        if not folder.removeprefix("file:").lstrip("/").startswith(self.uri.removeprefix("file:").lstrip("/")):
            raise ValueError(f"{folder} isn't of this workspace")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner drop the shuffle files of steps that are over. It takes two turns: what the
        first frees on this side is let go on the other."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25)


def _forget(uri: str) -> None:
    """At the driver's end, when Spark may be gone. A store that pyarrow can't open keeps the folder."""
    with contextlib.suppress(Exception):
        store, path = open_fs(uri)
        store.delete_dir(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; runs on executors too."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of any task uses. Readers take the names that successful
    attempts returned as rows, so files of failed attempts are never seen."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    return f"{prefix}-{part:05d}-{uuid.uuid4().hex}{suffix}"

