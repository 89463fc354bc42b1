"""Tables that grow by batches and stay a bounded number of folders (K1-K3).

Every batch is one run, a parquet folder. When a level has ``fan`` runs, they are combined into one run of the next level, so n
batches leave at most about ``fan * log(n)`` runs. Which runs count is told by a manifest: a small file, written aside and renamed,
whose number goes up by one. A batch that is replayed finds itself covered and changes nothing; a run that was written but never
named is not read. Runs that a manifest has replaced are deleted one manifest later, so a reader that just began can end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: runs of a level that are combined
FAN = 8


class Run(NamedTuple):
    """A folder below ``runs``, its level, and the batches it holds."""

    name: str
    level: int
    first: int
    last: int


class Levels:
    """The runs under a folder; ``combine`` makes one table of the rows of several runs."""

    def __init__(self, spark: SparkSession, root: str, combine: Callable[[DataFrame], DataFrame], fan: int = FAN, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.root, self.combine, self.fan, self.partition_by = spark, root.rstrip("/"), combine, fan, partition_by

    # -------------------------------------------------------------- files
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        store, folder = self._store(), self._path("manifest")
        if not store.exists(folder):
            return []
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, number: int) -> dict:
        stream = self._store().open(self._path("manifest", str(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, runs: list[Run], gone: list[str], schema: str) -> None:
        store, numbers = self._store(), self._manifests()
        aside = self._path("manifest", f"aside-{uuid.uuid4().hex}")
        stream = store.create(aside, False)
        stream.write(json.dumps({"runs": runs, "gone": gone, "schema": schema}).encode())
        stream.close()
        number = numbers[-1] + 1 if numbers else 0
        if not store.rename(aside, self._path("manifest", str(number))):
            raise RuntimeError(f"another writer has committed manifest {number} of {self.root}")
        for old in numbers[:-1]:
            for name in self._manifest(old)["gone"]:
                store.delete(self._path("runs", name), True)
            store.delete(self._path("manifest", str(old)), False)

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Run:
        name = f"{level}-{first}-{last}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*self.partition_by) if self.partition_by else rows.write
        writer.parquet(f"{self.root}/runs/{name}")
        return Run(name, level, first, last)

    # -------------------------------------------------------------- interface
    def runs(self) -> list[Run]:
        numbers = self._manifests()
        return [Run(*r) for r in self._manifest(numbers[-1])["runs"]] if numbers else []

    def covers(self, batch_id: int) -> bool:
        return any(r.last >= batch_id for r in self.runs())

    def read(self, runs: list[Run] | None = None) -> DataFrame | None:
        """The rows of all runs, or of some; null if there are none."""
        runs = self.runs() if runs is None else runs
        if not runs:
            return None
        schema = StructType.fromJson(json.loads(self._manifest(self._manifests()[-1])["schema"]))
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/runs/{r.name}") for r in runs]
        return reduce(DataFrame.unionByName, parts)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """One batch; ids go up. A batch that is there already is left as it is."""
        runs = self.runs()
        if any(r.last >= batch_id for r in runs):
            return
        schema = rows.schema.json()
        self._commit([*runs, self._write(rows, 0, batch_id, batch_id)], [], schema)
        while full := self._full():
            merged = self._write(self.combine(self.read(full)), full[0].level + 1, full[0].first, full[-1].last)
            rest = [r for r in self.runs() if r not in full]
            self._commit(sorted([*rest, merged], key=lambda r: r.first), [r.name for r in full], schema)

    def _full(self) -> list[Run]:
        """The runs of the lowest level that has enough of them."""
        by_level: dict[int, list[Run]] = {}
        for r in self.runs():
            by_level.setdefault(r.level, []).append(r)
        return next((runs for _, runs in sorted(by_level.items()) if len(runs) >= self.fan), [])

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """All runs as one, after ``change``; what it leaves out is gone."""
        runs = self.runs()
        if runs:
            level = max(r.level for r in runs) + 1
            whole = self._write(change(self.combine(self.read(runs))), level, runs[0].first, runs[-1].last)
            self._commit([whole], [r.name for r in runs], self._manifest(self._manifests()[-1])["schema"])
