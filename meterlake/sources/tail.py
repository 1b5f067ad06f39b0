"""Log folders as a streaming source that reads what was not sent yet, and no more.

An offset says of each file how many bytes were sent (up to the end of a line), and hashes of the first and of the last bytes
before that place.  A file that is as it was costs one entry of a listing; of one that has grown, its new bytes are read; one
that is shorter, or whose hashed bytes differ, was rewritten and is sent from its start.  Offsets are in the checkpoint, so a
restart goes on where the last batch ended.  The driver reads WINDOW bytes at each end of a changed file; lines are read by
tasks, long stretches by several.  A rewrite that changes neither the hashed bytes nor shortens the file isn't seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are hashed before a place, and in which the end of the last whole line is looked for first; of a task at most.
WINDOW, STRETCH = 4096, 32 << 20


class Stretch(InputPartition):
    """Lines of a file that begin at bytes from begin and before end."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.seen: dict[str, list] = {}  # of the last listing, by file: size, time of change, and its entry

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow.fs import FileSelector, FileType

        system, root = _filesystem(self.path)
        out = {}
        for x in system.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)):
            if x.type == FileType.File and x.path.endswith(self.suffix):
                known = self.seen.get(x.path)
                if not known or known[:2] != [x.size, x.mtime_ns]:
                    known = self.seen[x.path] = [x.size, x.mtime_ns, self._entry(system, x.path, x.size)]
                if known[2]["sent"]:
                    out[x.path] = known[2]
        return out

    def _hash(self, source, sent: int) -> str:
        sha = hashlib.sha256()
        for at in (0, max(0, sent - WINDOW)):
            source.seek(at)
            sha.update(source.read(min(WINDOW, sent - at)))
        return sha.hexdigest()

    def _entry(self, system, path: str, size: int) -> dict:
        """Up to where whole lines go, and the hash of bytes before."""
        with system.open_input_file(path) as source:
            at = size
            while at:
                begin = max(0, at - WINDOW)
                source.seek(begin)
                end = source.read(at - begin).rfind(b"\n")
                if end >= 0:
                    return {"sent": begin + end + 1, "hash": self._hash(source, begin + end + 1)}
                at = begin
        return {"sent": 0, "hash": ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        system, _ = _filesystem(self.path)
        for path, entry in end.items():
            was = start.get(path, {"sent": 0, "hash": ""})
            if was == entry:
                continue
            begin = was["sent"]
            if begin:
                with system.open_input_file(path) as source:
                    if entry["sent"] < begin or self._hash(source, begin) != was["hash"]:
                        begin = 0
            out += [Stretch(path, at, min(at + STRETCH, entry["sent"])) for at in range(begin, entry["sent"], STRETCH)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.file:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.file) as raw:
            # A stretch that begins inside a line leaves it to the one before.
            at = max(0, partition.begin - 1)
            raw.seek(at)
            source = raw  # lines are cut from blocks, as a file may be long
            block, skip = b"", partition.begin > 0
            while at < partition.end:
                end = block.find(b"\n")
                if end < 0:
                    more = source.read(1 << 20)
                    if not more:
                        return
                    block += more
                    continue
                line, block = block[:end], block[end + 1 :]
                if skip:
                    skip = False
                elif line:
                    yield (partition.file, at, line.decode("utf-8", "replace"))
                at += end + 1

    def commit(self, end: dict) -> None:
        pass


class LogFolder(DataSource):
    """spark.readStream.format("log_folder").option("suffix", ".jsonl").load(folder): file, at (the byte at which the line
    begins) and value of whole lines, empty ones left out."""

    @classmethod
    def name(cls) -> str:
        return "log_folder"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogFolder)
