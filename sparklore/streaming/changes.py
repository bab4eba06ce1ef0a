"""A streaming source of changed files: its offset is a snapshot of all paths with their sizes and times.

Spark's own file source delivers a file once; a log that grows or shrinks must come again. Between two snapshots every
path whose version differs is a row. A burst of changes is one batch: a snapshot becomes the offset when nothing has
changed for a while, or when the first of the changes has waited long enough. Where nothing changes at all, a row
without a path comes from time to time. The first batch has all files.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..shared import file_store

SCHEMA = "path string, size long, was long"
#: Rows of a partition.
ROWS = 10_000


def snapshot(roots: list[str], suffixes: list[str]) -> dict[str, list[int]]:
    """Size and time of each file below ``roots`` (or of one that is a root) with one of ``suffixes``; roots that are not there are passed over."""
    from pyarrow import fs

    out = {}
    for root in roots:
        store, path = file_store(root)
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if info.type == fs.FileType.Directory else [info]
        for f in found:
            if f.type == fs.FileType.File and f.path.endswith(tuple(suffixes)):
                out[f.path] = [f.size, f.mtime_ns or 0]
    return out


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.roots, self.suffixes, self.state = json.loads(options["roots"]), json.loads(options["suffixes"]), options["state"]
        self.quiet, self.most, self.idle = (float(options[k]) for k in ("quiet", "most", "idle"))
        self.offset: dict | None = None
        self.seen: tuple[str, float, float] | None = None  # what is pending: its name, since when it is as it is, and since when there is something
        self.last = time.time()

    def _saved(self, files: dict) -> str:
        """The snapshot's name, after it has been put where a later run of the query finds it."""
        text = json.dumps(files, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        store, folder = file_store(self.state)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}.part") as file:
            file.write(text.encode())
        store.move(f"{folder}/{name}.part", f"{folder}/{name}")
        return name

    def _files(self, name: str) -> dict:
        if not name:
            return {}
        store, folder = file_store(self.state)
        with store.open_input_stream(f"{folder}/{name}") as file:
            return json.loads(file.read())

    def initialOffset(self) -> dict:
        return {"snapshot": "", "round": 0}

    def latestOffset(self) -> dict:
        files, now = snapshot(self.roots, self.suffixes), time.time()
        name = hashlib.sha256(json.dumps(files, sort_keys=True).encode()).hexdigest()
        before = self.offset
        if before is not None and name == before["snapshot"]:
            self.seen = None
            if now - self.last < self.idle:
                return before
            self.offset = before | {"round": before["round"] + 1}
        else:
            if before is not None and self.quiet > 0:
                since = self.seen[2] if self.seen else now
                self.seen = self.seen if self.seen and self.seen[0] == name else (name, now, since)
                if now - self.seen[1] < self.quiet and now - since < self.most:
                    return before
            self.offset = {"snapshot": self._saved(files), "round": before["round"] if before else 0}
        self.seen, self.last = None, now
        return self.offset

    def partitions(self, start: dict, end: dict):
        """Paths whose versions differ; a batch of a query that goes on after a stop starts where the last one ended."""
        if self.offset is None:
            self.offset = end
        old, new = self._files(start["snapshot"]), self._files(end["snapshot"])
        rows = [(p, v[0], old[p][0] if p in old else None) for p, v in sorted(new.items()) if old.get(p) != v]
        rows += [(p, None, v[0]) for p, v in sorted(old.items()) if p not in new]
        if not rows and start["round"] != end["round"]:
            rows = [(None, None, None)]
        return [InputPartition(rows[at : at + ROWS]) for at in range(0, len(rows), ROWS)]

    def read(self, partition):
        yield from partition.value

    def commit(self, end: dict) -> None:
        """Snapshots other than the one that is done can go, but for one that was made just now."""
        from pyarrow import fs

        store, folder = file_store(self.state)
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name not in (end["snapshot"], (self.offset or end)["snapshot"]) and time.time_ns() - (f.mtime_ns or 0) > 60 * 10**9:
                store.delete_file(f.path)


class ChangedFiles(DataSource):
    """Options: ``roots`` and ``suffixes`` (JSON lists), ``state`` (a folder for snapshots), seconds ``quiet``, ``most`` and ``idle``."""

    @classmethod
    def name(cls):
        return "changed_files"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ChangeReader(self.options)


def changed_files(spark: SparkSession, roots: list[str], state: str, suffixes=(".jsonl", ".json", ".db"), quiet: float = 10, most: float = 900, idle: float = 900) -> DataFrame:
    """A stream of (path, size, was): changed files, new ones (``was`` null) and such as are gone (``size`` null); no path where nothing changed for ``idle``.

    Missing and empty roots have no files. ``state`` must outlive the query, as its checkpoint does.
    """
    spark.dataSource.register(ChangedFiles)
    options = {"roots": json.dumps(list(roots)), "suffixes": json.dumps(list(suffixes)), "state": state, "quiet": str(quiet), "most": str(most), "idle": str(idle)}
    return spark.readStream.format("changed_files").options(**options).load()
