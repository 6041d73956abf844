"""File-tree source.

Spark's own ``binaryFile`` reader hides every name that starts with ``_`` or ``.`` (``__init__.py``, ``.github/``),
so trees are listed by a small Python data source. Listing is split by sub-folder, and a folder with many files by shares of its
names; filters on ``repo_id`` and ``rel_path`` reach the walk and prune it. Contents are read afterwards, spread evenly over tasks,
and only when a query uses them.

A root is a path or a ``file:`` URI that every executor can open, or a URI of any store that Arrow knows (``hdfs:``, ``s3:`` ...).
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringEndsWith,
    StringStartsWith,
)

from repograin.functions.constants import COMPONENT_NAME_REGEXES, COMPONENT_PATTERNS, STORE_DIR

LISTING = "repo_id STRING, rel_path STRING, abs_path STRING, length BIGINT, mtime TIMESTAMP"
FRAME_BYTES = 32 << 20
UNIT_FILES = 8192  # files of one folder that a task lists
MODES = ("monitor", "component")


def hidden(rel_path: str, bare_patterns: Sequence[str], name_regexes: Sequence[str] = ()) -> bool:
    """The test of one entry, by its path and its own name; folders above it were already tested on the way down."""
    name = rel_path.rsplit("/", 1)[-1]
    return any(fnmatch.fnmatchcase(rel_path, p) or fnmatch.fnmatchcase(name, p) for p in bare_patterns) or any(
        re.fullmatch(r, name) for r in name_regexes
    )


def local_path(root: str) -> str | None:
    """The path of a root on this machine's file system, None for other stores."""
    parts = urlsplit(root)
    if not parts.scheme:
        return os.path.abspath(root)
    return unquote(parts.path) if parts.scheme == "file" and parts.netloc in ("", "localhost") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def entries(folder: str) -> Iterator[tuple[str, bool, object]]:
    """Name, whether it is a folder, and what knows its size and time, of all that lies in a folder."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        store, inner = _store(folder)
        for info in store.get_file_info(fs.FileSelector(inner)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield info.base_name, info.type == fs.FileType.Directory, info
        return
    with os.scandir(path) as found:
        for entry in found:
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, True, entry
            elif entry.is_file():
                yield entry.name, False, entry


def size_and_time(info: object) -> tuple[int, datetime]:
    if isinstance(info, os.DirEntry):
        stat = info.stat()
        return stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC)
    return info.size, info.mtime


def read_bytes(file: str) -> bytes | None:
    """Content of one file; None when it cannot be read."""
    path = local_path(file)
    try:
        if path is None:
            store, inner = _store(file)
            with store.open_input_stream(inner) as handle:
                return handle.read()
        with open(path, "rb") as handle:
            return handle.read()
    except OSError:
        return None


class Unit(InputPartition):
    """A folder, with all below it or only a share of its own files."""

    def __init__(self, rel: str, deep: bool, share: int = 0, shares: int = 1):
        self.rel = rel
        self.deep = deep
        self.share = share
        self.shares = shares


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options["path"]
        self.root = (local_path(root) or root).rstrip("/") or "/"
        self.repo = options.get("repo_id", self.root.rsplit("/", 1)[-1])
        self.mode = options.get("mode", MODES[0])
        patterns = json.loads(options.get("patterns", "[]"))
        self.patterns = [b for p in patterns if (b := p.rstrip("/") if self.mode == "monitor" else p)]
        self.regexes = COMPONENT_NAME_REGEXES if self.mode == "component" else []
        self.units = int(options.get("units", "64"))
        self.repos: list[set] = []
        self.starts: list[str] = []
        self.ends: list[str] = []
        self.among: list[set] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on path and repository prune the walk; Spark still applies all of them to what is listed."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)):
                values = {value} if isinstance(f, EqualTo) else set(value)
                (self.among if column == ("rel_path",) else self.repos if column == ("repo_id",) else []).append(values)
            elif column == ("rel_path",) and isinstance(f, StringStartsWith):
                self.starts.append(value)
            elif column == ("rel_path",) and isinstance(f, StringEndsWith):
                self.ends.append(value)
            yield f

    def _wanted(self, path: str, is_folder: bool) -> bool:
        if is_folder:
            lead = path + "/"
            inside = all(lead.startswith(s) or s.startswith(lead) for s in self.starts)
            return inside and all(any(str(v).startswith(lead) for v in values) for values in self.among)
        return (
            all(path.startswith(s) for s in self.starts)
            and all(path.endswith(e) for e in self.ends)
            and all(path in values for values in self.among)
        )

    def _children(self, rel: str) -> tuple[list[str], list[tuple[str, object]]]:
        folders, files = [], []
        for name, is_folder, info in entries(f"{self.root}/{rel}" if rel else self.root):
            path = f"{rel}/{name}" if rel else name
            if name == STORE_DIR or not self._wanted(path, is_folder) or hidden(path, self.patterns, self.regexes):
                continue
            if is_folder:
                folders.append(path)
            else:
                files.append((path, info))
        return sorted(folders), files

    def partitions(self) -> list[Unit]:
        """Split the listing: open folders level by level until there is enough to share out."""
        if any(self.repo not in values for values in self.repos):
            return []
        shallow, frontier = [], [""]
        while frontier and len(frontier) < self.units:
            below = []
            for rel in frontier:
                folders, files = self._children(rel)
                below += folders
                shares = -(-len(files) // UNIT_FILES)
                shallow += [Unit(rel, False, share, shares) for share in range(shares)]
            frontier = below
        return shallow + [Unit(rel, deep=True) for rel in frontier]

    def read(self, partition: Unit) -> Iterator[tuple]:
        pending = [partition.rel] if isinstance(partition, Unit) else []
        while pending:
            folders, files = self._children(pending.pop())
            if partition.deep:
                pending += folders
            for path, info in files:
                if partition.shares > 1 and zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.shares != partition.share:
                    continue
                yield self.repo, path, f"{self.root.rstrip('/')}/{path}", *size_and_time(info)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repograin_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def list_files(
    spark: SparkSession, root: str, patterns: Sequence[str] | None = None, repo_id: str | None = None, mode: str = "monitor"
) -> DataFrame:
    """Listing of one tree without contents: ``repo_id, rel_path, abs_path, length, mtime``.

    ``mode`` is ``monitor`` (no patterns unless given) or ``component`` (the component patterns unless given, and names that look
    temporary). Filters on the result prune the walk. Switches the filter push-down of Python sources on in this session.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    chosen = (COMPONENT_PATTERNS if mode == "component" else ()) if patterns is None else patterns
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("repograin_tree").option("path", root).option("mode", mode)
    reader = reader.option("patterns", json.dumps(list(chosen)))
    if repo_id is not None:
        reader = reader.option("repo_id", repo_id)
    return reader.load()


LANDED = ["repo_id", "rel_path", "length", "mtime", "content"]


def _read_contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read file bytes, emitting small frames so that a task never holds many contents."""
    for frame in frames:
        rows, held = [], 0
        for row in frame.itertuples(index=False):
            content = read_bytes(row.abs_path)  # None: the row stays, its hash is null
            rows.append((row.repo_id, row.rel_path, row.length, row.mtime, content))
            held += len(content or b"")
            if held >= FRAME_BYTES:
                yield pd.DataFrame(rows, columns=LANDED)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=LANDED)


def with_contents(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Landed rows ``(repo_id, rel_path, length, mtime, content)`` of listed files, ready for ``build_catalog``.

    The length is the listing's. The number of reading tasks is given outright: left to itself the engine would merge the
    tiny listing, and with it all the reading, into one task.
    """
    spark = listed.sparkSession
    default = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    spread = listed.repartition(tasks or default, F.xxhash64("rel_path"))
    return spread.mapInPandas(
        _read_contents, "repo_id string, rel_path string, length bigint, mtime timestamp, content binary"
    )


def read_files(
    spark: SparkSession,
    root: str,
    patterns: Sequence[str] | None = None,
    repo_id: str | None = None,
    tasks: int | None = None,
    mode: str = "monitor",
) -> DataFrame:
    """Listing and contents of one tree in one step."""
    return with_contents(list_files(spark, root, patterns, repo_id, mode), tasks)
