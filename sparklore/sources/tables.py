"""Keyed tables as Parquet in hash buckets, under a manifest that says which folders of each bucket count.

A write makes folders for the buckets of the keys it touches and then a new manifest, by which it takes effect as a
whole; other buckets stay as they are, so what is written grows with the change and not with the table. Readers see the newest
manifest, and of some keys read their buckets alone. What no kept manifest names is deleted.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..shared import checkpointed


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read, or is writing it."""


class TopicTable:
    """A table below ``path`` whose first column (or ``key``) is a key. Null keys are rows of one bucket.

    Writers are told apart: a manifest's number is claimed by making a file, which only one can, and a writer whose table
    has moved on since its ``read`` gets a ``Conflict`` instead of undoing the other's work.
    """

    #: Manifests kept for readers that began before the last ones; seconds after which a claim counts as left behind.
    KEPT, STALE = 3, 3600
    #: Of a new table; those of one that is there stay as they are. More suit one of many millions of keys.
    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.TOPICS, key: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.key, self.buckets = key or self.columns[0], buckets or self.BUCKETS
        self.base: list[str] | None = None

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return [f"{self.path}/{n}" for n in sorted(s.getPath().getName() for s in fs.listStatus(path(self.path))) if n.startswith("v")]

    def versions(self) -> list[str]:
        """The manifests kept, the oldest first."""
        return self._manifests()

    def _load(self, manifest: str) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(manifest))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _now(self) -> tuple[list[str], dict]:
        """The newest manifest's name (in a list; none before the first write), and what it says."""
        names = self._manifests()[-1:]
        return names, self._load(names[0]) if names else {"number": 0, "count": self.buckets, "buckets": {}}

    def _bucket(self, count: int, column: str | None = None):
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(count)).cast("int")

    def _files(self, held: dict, only: list[int] | None = None) -> DataFrame:
        parts = sorted({p for b, ps in held["buckets"].items() if only is None or int(b) in only for p in ps})
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def _buckets_of(self, rows: DataFrame, count: int) -> list[int]:
        return [r.b for r in rows.select(self._bucket(count).alias("b")).distinct().collect()]  # at most ``count``

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows; with ``keys`` (a column named like the key) at least those of such keys, from their buckets alone."""
        self.base, held = self._now()
        return self._files(held, None if keys is None else self._buckets_of(keys, held["count"]))

    def _write(self, rows: DataFrame, held: dict) -> dict[str, list[str]]:
        """A folder of ``rows`` for each of their buckets."""
        name = f"data-{uuid.uuid4().hex}"
        placed = rows.select(*self.columns).withColumn("bucket__", self._bucket(held["count"]))
        placed.repartition("bucket__").write.partitionBy("bucket__").parquet(f"{self.path}/{name}")
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{name}")) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{name}/{n}"] for n in found if n.startswith("bucket__=")}

    def _claimed(self, number: int) -> str:
        fs, path = self._fs()
        name = f"{self.path}/_claim-{number:09d}"
        if not fs.createNewFile(path(name)):
            age = time.time() - fs.getFileStatus(path(name)).getModificationTime() / 1000
            if age < self.STALE or not (fs.delete(path(name), False) and fs.createNewFile(path(name))):
                raise Conflict(f"{self.path} is being written")
        return name

    def _commit(self, base: list[str], held: dict, buckets: dict[str, list[str]]) -> None:
        """A manifest of ``buckets`` after that of ``base``, unless there is another by now."""
        fs, path = self._fs()
        number = held["number"] + 1
        claim = self._claimed(number)
        try:
            if base != self._manifests()[-1:]:
                raise Conflict(f"{self.path} has changed since it was read")
            part = f"{self.path}/_part-{uuid.uuid4().hex}"
            stream = fs.create(path(part))
            stream.write(bytearray(json.dumps({"number": number, "count": held["count"], "buckets": buckets}).encode()))
            stream.close()
            name = f"{self.path}/v{number:09d}.json"
            if not fs.rename(path(part), path(name)):
                raise Conflict(f"{name} cannot be written")
            self.base = [name]
            self._forget()
        finally:
            fs.delete(path(claim), False)

    def _forget(self) -> None:
        """Delete manifests before the last few, and the folders that only those named."""
        fs, path = self._fs()
        names = self._manifests()
        old, kept = names[: -self.KEPT], names[-self.KEPT :]
        if not old:
            return
        used = {p for n in kept for ps in self._load(n)["buckets"].values() for p in ps}
        gone = {p for n in old for ps in self._load(n)["buckets"].values() for p in ps} - used
        for p in gone:
            fs.delete(path(f"{self.path}/{p}"), True)
        for data in {p.partition("/")[0] for p in gone} - {p.partition("/")[0] for p in used}:
            fs.delete(path(f"{self.path}/{data}"), True)
        for n in old:
            fs.delete(path(n), False)

    def _checked(self) -> tuple[list[str], dict]:
        base, held = self._now()
        if self.base is not None and self.base != base:
            raise Conflict(f"{self.path} has changed since it was read")
        return base, held

    def replace(self, rows: DataFrame) -> None:
        """``rows``, which may be made from what ``read`` gave last, in place of all there are."""
        base, held = self._checked()
        self._commit(base, held, self._write(rows, held))

    def apply(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """``changed`` in place of the rows of their keys, or added; rows of the keys of ``deleted`` go. Other buckets are not touched."""
        base, held = self._checked()
        changed = checkpointed(changed.select(*self.columns))
        gone = changed.select(self.key) if deleted is None else checkpointed(changed.select(self.key).unionByName(deleted.select(self.key)))
        touched = self._buckets_of(gone, held["count"])
        if touched:
            rows = self._files(held, touched).join(gone, self.key, "left_anti").select(*self.columns).unionByName(changed)
            rest = {b: p for b, p in held["buckets"].items() if int(b) not in touched}
            self._commit(base, held, rest | self._write(rows, held))


class GrowingTable(TopicTable):
    """A table that is added to: a bucket has a folder for each addition to it, until they are made one.

    With ``newest`` rows of a key are versions, of which the one with the largest value there counts in the end;
    otherwise equal rows are one.
    """

    #: Folders of a bucket that ``append`` makes one of; times it tries to come in between other writers.
    MANY, TRIES = 16, 20

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, newest: str | None = None, buckets: int | None = None):
        super().__init__(spark, path, schema, key, buckets)
        self.newest = newest

    def versions(self) -> list[str]:
        """The additions that the newest manifest names."""
        return sorted({p.partition("/")[0] for ps in self._now()[1]["buckets"].values() for p in ps})

    def _added(self, new: dict[str, list[str]]) -> None:
        for turn in range(self.TRIES):
            base, held = self._now()
            try:
                return self._commit(base, held, held["buckets"] | {b: [*held["buckets"].get(b, []), *p] for b, p in new.items()})
            except Conflict:
                if turn == self.TRIES - 1:
                    raise
                time.sleep(0.1 * (turn + 1))
        return None

    def append(self, rows: DataFrame) -> None:
        """``rows`` beside those there are. Writers come one after the other, whatever they had read."""
        held = self._now()[1]
        new = self._write(rows, held)
        if new:
            self._added(new)
        full = [int(b) for b, p in self._now()[1]["buckets"].items() if len(p) > self.MANY]
        if full:
            self.compact(full)

    def compact(self, only: list[int] | None = None) -> None:
        """The additions to each bucket (or to those of ``only``) as one, without what is superseded."""
        base, held = self._now()
        only = [int(b) for b in held["buckets"]] if only is None else only
        rows = self._files(held, only)
        if self.newest:
            rest = [c for c in self.columns if c != self.key]
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.newest).alias("r")).select(self.key, "r.*")
        else:
            rows = rows.distinct()
        self._commit(base, held, {b: p for b, p in held["buckets"].items() if int(b) not in only} | self._write(rows, held))
