"""Landed search results as a data source of its own: folders of JSON lines by lane, read as a table or as a stream.

What fetched the posts writes <path>/lane=<lane>/<name>, names, which may have folders, in the order of time. A reader takes lanes that a
filter asks for, a file a partition, and a budget of files a lane; a stream's offset is the last name taken of each lane, so a
restarted one reads no file twice. Folders are reached through pyarrow's file systems: local ones and the object stores
and clusters it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition


def _files(path: str, lanes: set[str] | None) -> dict[str, list[str]]:
    """Names of the files of each lane, sorted."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found: dict[str, list[str]] = {}
    for folder in system.get_file_info(fs.FileSelector(root)):
        lane = folder.base_name.partition("lane=")[2]
        if folder.type == fs.FileType.Directory and lane and (lanes is None or lane in lanes):
            below = [f for f in system.get_file_info(fs.FileSelector(folder.path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
            found[lane] = sorted(f.path[len(folder.path) :].lstrip("/") for f in below)
    return found


@dataclass
class LandedFile(InputPartition):
    lane: str
    name: str


def _rows(path: str, part: LandedFile) -> Iterator[tuple[str, str, int, str]]:
    from pyarrow import fs

    full = f"{path.rstrip('/')}/lane={part.lane}/{part.name}"
    system, at = fs.FileSystem.from_uri(full) if "://" in full else (fs.LocalFileSystem(), full)
    with system.open_input_stream(at) as stream:
        rest, n = b"", 0
        while chunk := stream.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                if line.strip():
                    yield part.lane, part.name, n, line.decode("utf-8", "replace")
                n += 1
        if rest.strip():
            yield part.lane, part.name, n, rest.decode("utf-8", "replace")


class LandedReader(DataSourceReader):
    def __init__(self, path: str, lanes: set[str] | None, budget: int | None):
        self.path, self.lanes, self.budget = path, lanes, budget

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the lane choose folders; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("lane",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.lanes = asked if self.lanes is None else self.lanes & asked
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        found = _files(self.path, self.lanes)
        return [LandedFile(lane, name) for lane, names in sorted(found.items()) for name in (names[-self.budget :] if self.budget else names)]

    def read(self, part: LandedFile) -> Iterator[tuple]:
        return _rows(self.path, part)


class LandedStream(DataSourceStreamReader):
    def __init__(self, path: str, lanes: set[str] | None):
        self.path, self.lanes = path, lanes

    def initialOffset(self) -> dict:
        return {"last": "{}"}

    def latestOffset(self) -> dict:
        return {"last": json.dumps({lane: names[-1] for lane, names in _files(self.path, self.lanes).items() if names}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        first, last = json.loads(start["last"]), json.loads(end["last"])
        found = _files(self.path, self.lanes)
        return [LandedFile(lane, name) for lane, names in sorted(found.items()) for name in names if first.get(lane, "") < name <= last.get(lane, "")]

    def read(self, part: LandedFile) -> Iterator[tuple]:
        return _rows(self.path, part)


class LandedPosts(DataSource):
    """Options: path; lanes, names with commas between, all if missing; budget, the newest files a lane that a batch reads."""

    @classmethod
    def name(cls) -> str:
        return "landed_posts"

    def schema(self) -> str:
        return "lane string, file string, line long, value string"

    def _lanes(self) -> set[str] | None:
        given = self.options.get("lanes")
        return {x.strip() for x in given.split(",")} if given else None

    def reader(self, schema) -> LandedReader:
        budget = self.options.get("budget")
        return LandedReader(self.options["path"], self._lanes(), int(budget) if budget else None)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options["path"], self._lanes())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPosts)
