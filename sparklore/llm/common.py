"""What the operators of this subpackage share: shared-folder tables and CRC folds."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset a folder of this machine is taken if the executors are on it too (``local[...]``);
    otherwise that is an error, as they would not find what the others wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sparklore-shared")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


_made: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
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


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, any executor can reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def worker_state(key, make):
    """What ``make()`` built for ``key`` in this worker, which holds one such thing: another key's is let go first.

    Workers outlive tasks and serve several operators; their vocabularies and caches must not add up.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


class Remembered:
    """A worker's results by key, about twice ``bound`` at most: at the bound those not asked for since the last time are let go."""

    def __init__(self, bound: int):
        self.bound, self.recent, self.before = bound, {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that have to be made; the others are in ``recent`` then, as all of ``keys`` must be when asked for."""
        if len(self.recent) > self.bound:
            self.before, self.recent = self.recent, {}
        new = keys.difference(self.recent)
        if self.before:
            known = {k: self.before[k] for k in new if k in self.before}
            self.recent.update(known)
            new.difference_update(known)
        return new


def slices(texts: list[str], most: int = 1 << 20):
    """``texts`` in turn, as lists of ``most`` characters or a single text at most."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def small_batches(spark: SparkSession, rows: int = 500, size: int = 2 << 20) -> None:
    """Bound what one Arrow batch of whole texts can hold, by rows and by bytes.

    These are settings of the session, read when a query runs, so they stay; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_fold(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of ``key``: the same ones on every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def labelled_ids(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``most`` labelled rows of the training folds; of ids labelled twice, the larger label."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out_fold(id_col))
    return sample_by_hash(rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y")), "id", most)
