"""A streaming source that follows lines appended to files, which the file source does not see."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Span(InputPartition):
    """Bytes start to end of a file, both at line ends."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """Offsets are bytes by file. A file that became shorter is read from its beginning again."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def sizes(self) -> dict[str, int]:
        """Bytes up to the last line end of each file."""
        found = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if name[0] in "._" or not os.path.isfile(path):
                continue
            with open(path, "rb") as f:
                end = f.seek(0, 2)
                while end > 0:  # back to the last line end, a block at a time
                    start = max(0, end - 65_536)
                    f.seek(start)
                    at = f.read(end - start).rfind(b"\n")
                    if at >= 0:
                        end = start + at + 1
                        break
                    end = start
            found[path] = end
        return found

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        spans = []
        for path, size in after.items():
            at = before.get(path, 0)
            at = 0 if at > size else at
            if size > at:
                spans.append(Span(path, at, size))
        return spans

    def read(self, partition: Span) -> Iterator[tuple[str, str]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            left = partition.end - partition.start
            while left > 0:  # a line at a time; only a line feed ends one
                line = f.readline(left)
                if not line:
                    break
                left -= len(line)
                yield partition.path, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", folder): path, value of each appended line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"])
