"""Data sources: a recursive scan of directories, and playlist lines with their positions."""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tastemill.functions.paths import glob_regex


class FileScan(DataSource):
    """path, size, mtime of the files below ``roots`` (separated by newlines).

    Options: ``extensions`` (comma-separated, without case), ``exclude`` (globs,
    separated by newlines).  Links and special files are skipped, unreadable
    directories too; a file below two roots comes twice.  An excluded directory,
    a root included, is not entered.
    """

    @classmethod
    def name(cls) -> str:
        return "filescan"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _ScanReader(self.options)


class _ScanReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [os.path.normpath(os.path.abspath(r)) for r in options.get("roots", ".").split("\n") if r]
        self.extensions = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.globs = [("/" in g, glob_regex(g)) for g in options.get("exclude", "").split("\n") if g]

    def _out(self, path: str) -> bool:
        return any(re.search(p, path if whole else os.path.basename(path)) for whole, p in self.globs)

    def partitions(self):
        """A root's files, and each of its subdirectories, are a task of their own."""
        out = []
        for root in self.roots:
            if self._out(root):
                continue
            out.append(InputPartition((root, False)))
            try:
                with os.scandir(root) as entries:
                    out += [InputPartition((e.path, True)) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
        return out

    def read(self, partition):
        if partition is None:  # no root to enter
            return
        top, deep = partition.value
        todo = [top]
        while todo:
            path = todo.pop()
            if self._out(path):
                continue
            try:
                entries = sorted(os.scandir(path), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if deep:
                            todo.append(e.path)
                    elif e.is_file(follow_symlinks=False) and self._wanted(e):
                        s = e.stat(follow_symlinks=False)
                        yield e.path, s.st_size, datetime.fromtimestamp(max(0.0, s.st_mtime), UTC)
                except OSError:
                    continue

    def _wanted(self, e) -> bool:
        stem, dot, ext = e.name.rpartition(".")
        return (not self.extensions or (bool(stem) and bool(dot) and ext.lower() in self.extensions)) and not self._out(e.path)


class Playlist(DataSource):
    """pos, value of a playlist's lines after its header, which must be there."""

    @classmethod
    def name(cls) -> str:
        return "m3u"

    def schema(self) -> str:
        return "pos long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PlaylistReader(self.options["path"])


class _PlaylistReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        with open(self.path, encoding="utf-8") as f:
            first = f.readline()
            if first.strip() != "#EXTM3U":
                raise ValueError(f"{self.path} does not begin with #EXTM3U")
            for pos, line in enumerate(f, 1):
                yield pos, line.rstrip("\n").strip()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileScan)
    spark.dataSource.register(Playlist)


def scan(spark: SparkSession, roots: list[str], extensions=(), exclude=()) -> DataFrame:
    register(spark)
    # Relative roots are seen from here, not from a worker.
    reader = spark.read.format("filescan").option("roots", "\n".join(os.path.abspath(r) for r in roots))
    return reader.option("extensions", ",".join(extensions)).option("exclude", "\n".join(exclude)).load()
