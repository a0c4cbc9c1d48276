"""File trees as a Python data source: one row per file, planned by bytes.

Planning lists folders with many threads until ``LISTED`` files are known, and packs the files that size, extension
and pushed predicates leave into partitions of about ``PART_BYTES``. What lies in folders beyond is not listed by the
planner: each such folder is walked by several tasks, of which every one reads its own share of the paths. So no task has
to see the whole tree, and neither planning nor a task holds more than a bounded number of names.

Names that begin with a dot or an underscore count like all others, which is why Spark's own file listing is not used.
Links to folders are not followed, as they may lead back up. A file that is gone or unreadable when it is read is left out.
"""

from __future__ import annotations

import json
import sys
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

LISTED = 1_000_000
PART_BYTES = 32 << 20
# What opening a file costs beside its bytes, as bytes; small files spread over tasks by it.
OPEN_BYTES = 256 << 10
# Tasks that walk one folder the planner has not listed.
WALKERS = 16
THREADS = 32
BATCH_BYTES = 4 << 20

LISTING = "file_path string, path string, length long"
CONTENT = f"{LISTING}, content binary"


class Found(NamedTuple):
    path: str
    length: int
    changed: float


class Wanted(NamedTuple):
    """Predicates on a file, all of which are known from its listing."""

    max_bytes: int
    suffixes: tuple[str, ...]
    prefixes: tuple[str, ...]
    paths: frozenset[str] | None
    after: float
    until: float

    def keeps(self, relative: str, file: Found) -> bool:
        name = relative.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        return (
            file.length <= self.max_bytes
            and (name[dot:].lower() if dot > 0 else "") not in self.suffixes
            and all(relative.startswith(p) for p in self.prefixes)
            and (self.paths is None or relative in self.paths)
            and self.after < file.changed <= self.until
        )


class Part(InputPartition):
    """Files to read, and folders to walk: each with the share of its paths that is read."""

    def __init__(self, files: list[Found], folders: list[tuple[str, int]], wanted: Wanted):
        self.files, self.folders, self.wanted = files, folders, wanted


class Tree:
    """A root folder on any file system pyarrow knows."""

    def __init__(self, root: str, subtree: str = ""):
        self.root, self.subtree = root, subtree.strip("/")
        self.local = root.startswith("/") or root.startswith("file:")

    def system(self):
        """The file system, and the root's path within it."""
        from pyarrow import fs

        if self.local:
            path = "/" + self.root[5:].lstrip("/") if self.root.startswith("file:") else self.root
            return fs.LocalFileSystem(), path.rstrip("/")
        system, path = fs.FileSystem.from_uri(self.root)
        return system, path.rstrip("/")

    def children(self, system, folder: str) -> tuple[list[Found], list[str]]:
        """Files and folders right below a folder."""
        import os

        from pyarrow import fs

        entries = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        files = [Found(e.path, e.size, (e.mtime_ns or 0) / 1e9) for e in entries if e.type == fs.FileType.File]
        folders = [e.path for e in entries if e.type == fs.FileType.Directory and not (self.local and os.path.islink(e.path))]
        return files, folders

    def list(self, wanted: Wanted, most: int) -> tuple[list[Found], list[str]]:
        """Wanted files, and folders that were left when ``most`` files had been seen."""
        system, base = self.system()
        start = f"{base}/{self.subtree}" if self.subtree else base
        files, level, seen = [], [start], 0
        with ThreadPoolExecutor(THREADS) as pool:
            while level and seen < most:
                now, level = level[: 4 * THREADS], level[4 * THREADS :]
                for found, folders in pool.map(lambda folder: self.children(system, folder), now):
                    seen += len(found)
                    files += [f for f in found if wanted.keeps(f.path[len(base) + 1 :], f)]
                    level += folders
        return files, level

    def walk(self, folder: str, share: int, wanted: Wanted) -> Iterator[Found]:
        system, base = self.system()
        left = [folder]
        while left:
            found, folders = self.children(system, left.pop())
            left += folders
            yield from (f for f in found if zlib.crc32(f.path.encode()) % WALKERS == share and wanted.keeps(f.path[len(base) + 1 :], f))

    def plan(self, wanted: Wanted, part_bytes: int, most: int) -> list[Part]:
        """Partitions of about ``part_bytes`` in the order of paths, and those that walk what is not listed."""
        files, folders = self.list(wanted, most)
        parts, held, size = [], [], 0
        for f in sorted(files):
            if held and size + f.length + OPEN_BYTES > part_bytes:
                parts.append(Part(held, [], wanted))
                held, size = [], 0
            held.append(f)
            size += f.length + OPEN_BYTES
        if held:
            parts.append(Part(held, [], wanted))
        parts += [Part([], [(folder, share)], wanted) for folder in folders for share in range(WALKERS)]
        return parts or [Part([], [], wanted)]

    def rows(self, part: Part, content: bool) -> Iterator[pa.RecordBatch]:
        system, base = self.system()
        names = ["file_path", "path", "length", "content"][: 4 if content else 3]
        types = [pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        schema = pa.schema(list(zip(names, types, strict=True)))
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)

        def files() -> Iterator[Found]:
            yield from part.files
            for folder, share in part.folders:
                yield from self.walk(folder, share, part.wanted)

        for f in files():
            row = (f.path[len(base) + 1 :], f.path, f.length)
            if content:
                try:
                    with system.open_input_file(f.path) as file:
                        row = (*row, file.read())
                except OSError:
                    continue
            held.append(row)
            size += len(row[3]) if content else 256
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options["path"], options.get("subtree", ""))
        self.content = options.get("content", "true") == "true"
        self.part_bytes, self.most = int(options.get("part_bytes", PART_BYTES)), int(options.get("listed", LISTED))
        self.wanted = wanted(options)

    def partitions(self) -> list[Part]:
        return self.tree.plan(self.wanted, self.part_bytes, self.most)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.tree.rows(partition, self.content)


class PushingTreeReader(TreeReader):
    """For sessions that push predicates down; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what a listing can tell; the rest stays with Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, LessThan | LessThanOrEqual) and column == ("length",):
                limit = f.value - isinstance(f, LessThan)
                self.wanted = self.wanted._replace(max_bytes=min(self.wanted.max_bytes, limit))
            elif isinstance(f, StringStartsWith) and column == ("file_path",):
                self.wanted = self.wanted._replace(prefixes=(*self.wanted.prefixes, f.value))
            elif isinstance(f, EqualTo | In) and column == ("file_path",):
                paths = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = self.wanted._replace(paths=paths if self.wanted.paths is None else self.wanted.paths & paths)
            else:
                yield f


class TreeStream(DataSourceStreamReader):
    """Files by the time they were changed: a batch has those changed after one time and until another.

    The newest ``settle`` seconds are left to the next batch, so that no file is missed that gets the same time later.
    A changed file comes again. A replayed batch lists the same span of time.
    """

    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options["path"], options.get("subtree", ""))
        self.content = options.get("content", "true") == "true"
        self.part_bytes, self.most = int(options.get("part_bytes", PART_BYTES)), int(options.get("listed", LISTED))
        self.settle, self.wanted = float(options.get("settle", 2)), wanted(options)

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": time.time() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.plan(self.wanted._replace(after=start["until"], until=end["until"]), self.part_bytes, self.most)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.tree.rows(partition, self.content)

    def commit(self, end: dict) -> None:
        pass


def wanted(options: dict[str, str]) -> Wanted:
    suffixes = tuple(json.loads(options.get("skip_suffixes", "[]")))
    return Wanted(int(options.get("max_bytes", 1 << 62)), suffixes, (), None, -1.0, float("inf"))


class TreeSource(DataSource):
    """Options: ``path``; ``subtree``, ``max_bytes``, ``skip_suffixes`` (a JSON list), ``content`` (false lists only),
    ``part_bytes``, ``listed``; ``pushdown`` for sessions with ``spark.sql.python.filterPushdown.enabled``; ``settle`` for streams."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return CONTENT if self.options.get("content", "true") == "true" else LISTING

    def reader(self, schema) -> TreeReader:
        made = PushingTreeReader if self.options.get("pushdown") == "true" else TreeReader
        return made(dict(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(dict(self.options))


def use_trees(spark: SparkSession) -> None:
    """Make the format ``file_tree`` known to a session."""
    spark.dataSource.register(TreeSource)


# Tasks get the code itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
