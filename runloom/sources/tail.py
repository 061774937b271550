"""A stream of the lines of files that grow: a Python data source whose offsets are bytes, so that a line is read once, whenever it is finished.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", folder).load()      (file, at, line)

An offset holds, for each file, how far its finished lines reach and its first bytes. A file that has become shorter, or that begins with other bytes than
it did, was rewritten and is read from its start again. A batch is split into ranges of ``CHUNK`` bytes that are read side by side, line by line, so neither a
backlog nor a huge file meets in one task; a restart goes on from the offsets in the checkpoint. A last line without its line end waits for it, unless ``drain`` is
set, for a last run when the writer has ended. The path is one that the driver and all executors see: local to all, or a URI that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK, HEAD, BLOCK = 8 << 20, 256, 1 << 16


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at byte start or later, and before byte stop."""

    file: str
    start: int
    stop: int
    whole: bool  # a line begins at start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.drain = options["path"], options.get("drain", "false").lower() == "true"
        self.chunk = int(options.get("chunk", CHUNK))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_: Any) -> dict:
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        out = {}
        for f in files:
            if f.type != fs.FileType.File or f.base_name[0] in "._":
                continue
            with system.open_input_file(f.path) as x:
                head = x.read_at(min(HEAD, f.size), 0)
                end = f.size if self.drain else self._finished(x, f.size)
            if end:
                out[f.path] = [end, head[:end].decode("latin-1")]
        return out

    @staticmethod
    def _finished(x: Any, size: int) -> int:
        """Up to where the lines are finished."""
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            last = x.read_at(at - begin, begin).rfind(b"\n")
            if last >= 0:
                return begin + last + 1
            at = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, (stop, head) in sorted(end.items()):
            was, began = start.get(file, [0, ""])
            same = was <= stop and head.startswith(began)
            at = was if same else 0
            for a in range(at, stop, self.chunk):
                out.append(Range(file, a, min(a + self.chunk, stop), a == at))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = self._open()
        with system.open_input_file(partition.file) as x:
            at, rest = partition.start, b""
            if not partition.whole:  # the line that began before belongs to the range before, unless it ends right there
                at -= 1
            x.seek(at)
            skip, begin = not partition.whole, at
            while True:
                block = x.read(BLOCK)
                rest += block
                parts = rest.split(b"\n")
                rest = parts.pop()
                for part in parts:
                    if not skip:
                        if begin >= partition.stop:
                            return
                        yield partition.file, begin, part.rstrip(b"\r").decode("utf-8", "replace")
                    skip = False
                    begin += len(part) + 1
                if not block or begin >= partition.stop:
                    break
            if rest and not skip and begin < partition.stop:  # drained
                yield partition.file, begin, rest.rstrip(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return TailReader(self.options)
