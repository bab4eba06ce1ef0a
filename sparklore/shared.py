"""The shared folder and checkpoints: where lineage is cut so that any executor can reread it."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in the session's ``spark.checkpoint.dir``; where that is unset, one of this machine if the executors are on it too."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sparklore-shared")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


_made: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _drop_scratch() -> None:
    for path, spark in _made.items():
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session is gone: nothing left to ask
            return


def local_path(path: str) -> str:
    """``path`` for the file system's own calls, which SQLite makes; an error where it names another store."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file") or parts.netloc:
        raise ValueError(f"{path}: SQLite files need a shared folder that is mounted as a file system")
    return unquote(parts.path) if parts.scheme else path


def file_store(uri: str):
    """The Arrow file system of ``uri``, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri.removeprefix('file:').lstrip('/')}")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()
