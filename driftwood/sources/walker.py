"""A Spark data source that walks a directory tree: one partition for each entry below the root.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree_walk").option("path", "/shared/folder").load()

The folder has to be one that all executors see.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftwood.functions.scalars import S_IFMT

SCHEMA = "parent string, name string, kind string, mode int, size bigint, blocks bigint, nlink bigint, mtime_sec bigint, mtime_nsec bigint, ino bigint, target string, error string"


class Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _entry(parent: str, name: str) -> tuple:
    path = os.path.join(parent, name)
    try:
        s = os.lstat(path)
        target = os.readlink(path) if stat.S_ISLNK(s.st_mode) else None
    except OSError as e:
        return (parent, name, *[None] * 9, e.strerror)
    return parent, name, S_IFMT.get(s.st_mode & 0o170000), s.st_mode & 0o7777, s.st_size, s.st_blocks, s.st_nlink, int(s.st_mtime_ns // 10**9), int(s.st_mtime_ns % 10**9), s.st_ino, target, None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> list[Subtree]:
        below = [Subtree(e.path, True) for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [Subtree(self.root, False), *sorted(below, key=lambda p: p.path)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            path = todo.pop()
            try:
                names = sorted(os.listdir(path))
            except OSError as e:
                # An unreadable directory is listed as empty, with its error.
                yield (path, None, *[None] * 9, e.strerror)
                continue
            for name in names:
                row = _entry(path, name)
                yield row
                if partition.deep and row[2] == "dir":
                    todo.append(os.path.join(path, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
