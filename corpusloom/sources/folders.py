"""Folders as a data source, for batch and stream: ``spark.read.format("corpus_folder").option("roots", ...)``.

Tasks walk the tree from folders near the roots and read the files they find; filters on type, size
and path are applied while walking.  Paths go through pyarrow's file systems, so any store that
these open will do.  As a stream it gives files by time of change, each once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

SCHEMA = "path string, size long, modified_at timestamp, type string, content binary"
#: Folders that the walk starts from, at least, where the tree has them; files of a task of a stream.
STARTS, FILES_A_TASK = 64, 256


class Walk(InputPartition):
    """A folder that a task walks; ``deep``: with all below it."""

    def __init__(self, root: str, folder: str, deep: bool) -> None:
        self.root, self.folder, self.deep = root, folder, deep


class Files(InputPartition):
    def __init__(self, root: str, paths: list[str]) -> None:
        self.root, self.paths = root, paths


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it and what stands before its paths in Spark's names."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root, "file:"
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/"), "file:"
    store, path = fs.FileSystem.from_uri(root)
    return store, path, root[: len(root) - len(path)] if root.endswith(path) else root.split("://")[0] + "://"


def _listed(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((i for i in found if not i.base_name.startswith(".")), key=lambda i: i.path)


def _files(store: fs.FileSystem, folder: str, deep: bool) -> Iterator[fs.FileInfo]:
    left = [folder]
    while left:
        for info in _listed(store, left.pop()):
            if info.type == fs.FileType.Directory:
                if deep:
                    left.append(info.path)
            elif info.type == fs.FileType.File:
                yield info


def _kind(info: fs.FileInfo) -> str:
    return info.extension.lower()


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b),
}


class FolderReader(DataSourceReader):
    def __init__(self, roots: list[str], with_content: bool) -> None:
        self.roots, self.with_content, self.filters = roots, with_content, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests on path, size and type are ours; the rest goes back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and column in (("path",), ("size",), ("type",)) and getattr(f, "value", None) is not None:
                self.filters.append((column[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            store, path, _ = opened(root)
            front = [path]
            while front and len(front) < STARTS:  # a level further down; folders above it are listed without what is below
                below = [i.path for folder in front for i in _listed(store, folder) if i.type == fs.FileType.Directory]
                out += [Walk(root, folder, False) for folder in front]
                front = below
            out += [Walk(root, folder, True) for folder in front]
        return out

    def read(self, partition: Walk) -> Iterator[tuple]:
        store, _, before = opened(partition.root)
        for info in _files(store, partition.folder, partition.deep):
            known = {"path": before + info.path, "size": info.size, "type": _kind(info)}
            if all(_TESTS[kind](known[column], value) for column, kind, value in self.filters):
                yield _row(store, info, before, self.with_content)


def _row(store: fs.FileSystem, info: fs.FileInfo, before: str, with_content: bool) -> tuple:
    content = None
    if with_content:
        with store.open_input_stream(info.path) as f:
            content = f.read()
    return before + info.path, info.size, info.mtime, _kind(info), content


class FolderStream(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds: a batch takes the files changed after the last and up to the newest.

    Files younger than ``settle`` seconds wait for the next poll, so one that appears with the same
    time as the newest seen isn't missed.
    """

    def __init__(self, roots: list[str], with_content: bool, settle: float) -> None:
        self.roots, self.with_content, self.settle = roots, with_content, settle

    def initialOffset(self) -> dict:
        return {"ns": "0"}

    def _infos(self) -> Iterator[tuple[str, fs.FileInfo]]:
        for root in self.roots:
            store, path, _ = opened(root)
            for info in _files(store, path, True):
                yield root, info

    def latestOffset(self) -> dict:
        ripe = int((time.time() - self.settle) * 1e9)
        return {"ns": str(max((i.mtime_ns for _, i in self._infos() if i.mtime_ns <= ripe), default=0))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found: dict[str, list[str]] = {}
        for root, info in self._infos():
            if int(start["ns"]) < info.mtime_ns <= int(end["ns"]):
                found.setdefault(root, []).append(info.path)
        return [Files(root, paths[i : i + FILES_A_TASK]) for root, paths in found.items() for i in range(0, len(paths), FILES_A_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _, before = opened(partition.root)
        for info in store.get_file_info(partition.paths):
            if info.type == fs.FileType.File:  # gone since the poll
                yield _row(store, info, before, self.with_content)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Options: ``roots`` (JSON list or one path), ``content`` (true or false), ``settle`` (seconds, for streams)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_folder"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self) -> tuple[list[str], bool]:
        roots = self.options.get("roots") or self.options["path"]
        return json.loads(roots) if roots.startswith("[") else [roots], self.options.get("content", "true") == "true"

    def reader(self, schema) -> FolderReader:
        return FolderReader(*self._asked())

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(*self._asked(), float(self.options.get("settle", "1")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, filters pushed down included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
