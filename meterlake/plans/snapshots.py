"""Tables made of immutable segments, and numbered manifests that say which segments are live.

An append writes a segment and then the next manifest; a merge writes one segment for several of a level and then a manifest
without these.  A manifest names the segments of all tables, so a reader that has loaded one sees all of them as they were
at one moment, and a job that was lost leaves a folder that no manifest names.  FAN segments of a level become one of the
next, so n appends leave about FAN * log(n) segments, and each row is written again about log(n) times.  One writer at a
time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Segments of one level before they are merged; manifests that stay for readers; seconds that a dead segment stays.
FAN, KEPT, GRACE = 8, 16, 3600.0


class NumberedFiles:
    """Small JSON files below a folder, each whole: written beside and then renamed; the last one holds."""

    def __init__(self, spark: SparkSession, folder: str, kept: int = 2):
        self.spark, self.folder, self.kept = spark, folder, kept
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        if not self.fs.exists(self.path(self.folder)):
            return 0
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def load(self) -> dict:
        n = self.last()
        if not n:
            return {}
        stream = self.fs.open(self.path(f"{self.folder}/{n:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, state: dict) -> None:
        n = self.last() + 1
        part, whole = self.path(f"{self.folder}/.{n:09d}.part"), self.path(f"{self.folder}/{n:09d}.json")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(state, default=str).encode()))
        out.close()
        if not self.fs.rename(part, whole):
            raise OSError(f"could not write {whole}")
        self.fs.delete(self.path(f"{self.folder}/{n - self.kept:09d}.json"), False)


class Snapshots:
    """reduce: for each table a function of its rows and of a reader of other tables, which leaves what is live.  It must
    give the same whether it is applied to some segments first or to all of them."""

    def __init__(self, spark: SparkSession, root: str, reduce: dict[str, Callable[[DataFrame, Callable], DataFrame]], fan: int = FAN, grace: float = GRACE):
        self.spark, self.root, self.reduce, self.fan, self.grace = spark, root, reduce, fan, grace
        self.files = NumberedFiles(spark, f"{root}/manifest", KEPT)
        self.frames: dict[str, tuple[tuple[str, ...], DataFrame]] = {}

    def load(self) -> dict:
        """Of each table the live segments (folder and level), and under `writes` how often rows were appended to it."""
        return self.files.load()

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        segments = (self.load() if state is None else state).get(name)
        return self._rows(name, segments) if segments else None

    def _rows(self, name: str, segments: Iterable) -> DataFrame:
        """Segments don't change, so their files are listed once, until the table has others."""
        base, folders = f"{self.root}/{name}", tuple(folder for folder, _ in segments)
        if self.frames.get(name, ((), None))[0] != folders:
            self.frames[name] = folders, self.spark.read.option("basePath", base).parquet(*[f"{base}/{x}" for x in folders]).drop("segment")
        return self.frames[name][1]

    def _write(self, df: DataFrame, name: str, level: int, by: tuple[str, ...]) -> list:
        folder = f"segment={uuid.uuid4().hex}"
        place = f"{self.root}/{name}/{folder}"
        (df.hint("rebalance", *by) if by else df.coalesce(1)).write.partitionBy(*by).parquet(place)
        there = [x.getPath().getName() for x in self.files.fs.listStatus(self.files.path(place))]
        return [[folder, level]] if any(x[0] not in "_." for x in there) else []

    def append(self, *rows: tuple[str, DataFrame, tuple[str, ...]]) -> None:
        """Each a table, its new rows, and the columns by which their files are parted; those of a table without such
        columns are few.  All appear at once.  Levels that are full are merged afterwards."""
        made = [(name, by, self._write(df, name, 0, by)) for name, df, by in rows]
        state = self.load()
        writes = state.setdefault("writes", {})
        for name, _, segments in made:
            state[name] = state.get(name, []) + segments
            writes[name] = writes.get(name, 0) + 1
        self.files.save(state)
        for name, by, _ in made:
            self.merge(name, by)

    def merge(self, name: str, by: tuple[str, ...]) -> None:
        level, state = 0, self.load()
        while len(full := [s for s in state.get(name, []) if s[1] == level]) >= self.fan:
            rows = self.reduce[name](self._rows(name, full), lambda other: self.read(other, state))  # noqa: B023
            merged = self._write(rows, name, level + 1, by)
            state = self.load()
            state[name] = [s for s in state[name] if s not in full] + merged
            self.files.save(state)
            self.sweep(name)
            level += 1

    def sweep(self, name: str) -> None:
        """Deletes segments that no manifest names and that are so old that no reader has them."""
        live, now = {s[0] for s in self.load().get(name, [])}, time.time()
        for x in self.files.fs.listStatus(self.files.path(f"{self.root}/{name}")):
            if x.getPath().getName() not in live and now - x.getModificationTime() / 1000 > self.grace:
                self.files.fs.delete(x.getPath(), True)
