"""File trees as tables.

``file_tree`` is a Python data source: one partition per folder at the top, pruned folders are
never entered. ``file_predicate`` gives the same conditions as Columns for tables of files.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are left out unless named otherwise, and the size limit.
EXCLUDED_FOLDERS = (".git", ".vs", "node_modules")
MAX_BYTES = 100 * 1024 * 1024
SCHEMA = "root string, path string, is_directory boolean, size_bytes long, modified timestamp, created timestamp, hidden boolean"


def glob_regex(pattern: str) -> str:
    """A glob of ``*``, ``?`` and ``\\`` as escape, as an anchored expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return f"(?ius)^{''.join(out)}$"


def extension_list(text: str) -> list[str]:
    """Extensions of a list with ``; ,`` or blanks between, in lower case with a dot, each once."""
    parts = (p.lstrip("*").lower() for p in re.split(r"[;,\s]+", text) if p.strip("*"))
    return list(dict.fromkeys(p if p.startswith(".") else f".{p}" for p in parts if p))


def file_predicate(
    min_size: int = 0, max_size: int = 0, modified_after=None, modified_before=None, include_ext: list[str] | None = None, exclude_ext: list[str] | None = None,
    include_globs: list[str] | None = None, exclude_globs: list[str] | None = None, include_dirs: list[str] | None = None, exclude_dirs: list[str] | None = None,
) -> Column:
    """Conditions on files as a Column; bounds are inclusive and hold where set, sets and globs ignore case, globs see the name alone."""
    out = F.lit(True)
    if min_size > 0:
        out &= F.col("size_bytes") >= min_size
    if max_size > 0:
        out &= F.col("size_bytes") <= max_size
    if modified_after is not None:
        out &= F.col("modified") >= F.lit(modified_after)
    if modified_before is not None:
        out &= F.col("modified") <= F.lit(modified_before)
    if include_ext:
        out &= F.lower("ext").isin(*map(str.lower, include_ext))
    if exclude_ext:
        out &= ~F.lower("ext").isin(*map(str.lower, exclude_ext))
    any_of = lambda globs: F.coalesce(F.greatest(*(F.col("file_name").rlike(glob_regex(g)) for g in [*globs, *globs[:1]])), F.lit(False))
    if include_globs:
        out &= any_of(include_globs)
    if exclude_globs:
        out &= ~any_of(exclude_globs)
    among = lambda names: F.arrays_overlap(F.split(F.lower("rel_dir"), "/"), F.array(*(F.lit(n.lower()) for n in names)))
    if include_dirs:
        out &= among(include_dirs) | F.lower(F.substring_index("root", "/", -1)).isin(*map(str.lower, include_dirs))
    if exclude_dirs:
        out &= ~among(exclude_dirs)
    return out


class _Folder(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split("\n") if r]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("includehidden", options.get("includeHidden", "false")).lower() == "true"
        self.excluded = {x.lower() for x in options.get("exclude", "\n".join(EXCLUDED_FOLDERS)).split("\n") if x}

    def partitions(self) -> list[_Folder]:
        out: list[_Folder] = []
        for root in self.roots:  # roots that don't exist are left out; roots that repeat are read again
            if not os.path.isdir(root):
                continue
            out.append(_Folder(root, root, False))
            if self.recursive:
                out += [_Folder(root, e.path, True) for e in self._entries(root) if e.is_dir(follow_symlinks=False) and self._enter(e)]
        return out or [_Folder("", "", False)]

    def _entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as it:
                return sorted(it, key=lambda e: e.name)
        except OSError:
            return []

    def _hidden(self, name: str) -> bool:
        return name.startswith(".")

    def _enter(self, e: os.DirEntry) -> bool:
        return e.name.lower() not in self.excluded and (self.hidden or not self._hidden(e.name))

    def _row(self, root: str, path: str, st: os.stat_result) -> tuple:
        at = lambda t: datetime.fromtimestamp(t, UTC)
        folder = stat.S_ISDIR(st.st_mode)
        return (root, path, folder, None if folder else st.st_size, at(st.st_mtime), at(st.st_ctime), self._hidden(os.path.basename(path)))

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.folder:
            return
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            try:
                yield self._row(partition.root, folder, os.stat(folder))
            except OSError:
                continue
            for e in self._entries(folder):
                try:
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and self._enter(e):
                            todo.append(e.path)
                    elif e.is_file() and (self.hidden or not self._hidden(e.name)):
                        yield self._row(partition.root, e.path, e.stat())
                except OSError:
                    continue


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("roots", "/a\\n/b")``; files and folders, with pruning while listing."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def walk(spark: SparkSession, roots: list[str], recursive: bool = True, include_hidden: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """Files and folders below the roots."""
    spark.dataSource.register(FileTree)
    r = spark.read.format("file_tree").option("roots", "\n".join(roots)).option("recursive", str(recursive)).option("includehidden", str(include_hidden))
    if exclude is not None:
        r = r.option("exclude", "\n".join(exclude))
    return r.load()


def read_bytes(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, content`` of the files; files that vanished or exceed the limit have null content."""

    def run(frames):
        for f in frames:
            out = []
            for p in f["path"]:
                try:
                    with open(p, "rb") as h:
                        data = h.read(max_bytes + 1)
                    out.append(data if len(data) <= max_bytes else None)
                except OSError:
                    out.append(None)
            f = f[["path"]].copy()
            f["content"] = out
            yield f

    return files.where("not is_directory").select("path").mapInPandas(run, "path string, content binary")


def fixed_list(files: DataFrame, scope: DataFrame) -> DataFrame:
    """The files of an explicit list (``path``)."""
    return files.join(scope.select("path").distinct(), "path", "left_semi")


