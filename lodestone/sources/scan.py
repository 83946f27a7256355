"""Directory trees as a DataFrame: the Python data source ``file_scan``.

The listing rules differ from Spark's own file sources: names that begin with ``_`` are seen, hidden files are kept while
hidden directories are pruned, symbolic links and depth are under control, and every refusal is a row
with its reason.  A partition walks one directory with all below it, or the files of one directory alone: directories are
opened on the driver, level by level, until there are enough of them to walk side by side.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterable, Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.session import ship

from .pushed import Condition, Wanted, said

#: Supported extensions by category.
CATEGORIES = {
    "plain_text": (".txt", ".md", ".log"),
    "source_code": (".py", ".cpp", ".c", ".h", ".js", ".ts", ".java"),
    "pdf": (".pdf",),
    "word": (".docx", ".odt"),
    "presentation": (".pptx", ".odp"),
    "spreadsheet": (".xlsx", ".xls", ".ods", ".csv"),
    "email": (".eml",),
    "web": (".html", ".htm"),
}
CATEGORY_OF = {e: c for c, es in CATEGORIES.items() for e in es}

#: Directories that are never entered.
IGNORED = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", "node_modules",
    "venv", ".venv", "env", ".env", "dist", "build", ".idea", ".vscode",
)

DEPTH = 200
#: Directories to walk side by side, about.
PARTS = 256
MB = 1 << 20
#: Seconds that a file must have been left alone before a stream takes it.
SETTLED = 1.0
STATUS = 7  # place of status in a row
SCHEMA = "absolute_path string, relative_path string, real_path string, extension string, format_category string, size_bytes long, modified_ts double, status string, reason string"

NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def supported_extensions() -> list[str]:
    return sorted(CATEGORY_OF)


def is_supported(extension: str) -> bool:
    return extension.lower() in CATEGORY_OF


def format_category(extension: str) -> str | None:
    return CATEGORY_OF.get(extension.lower())


class Tree(InputPartition):
    def __init__(self, top: str, deep: bool, since: int | None = None, until: int | None = None):
        super().__init__((top, deep, since, until))
        self.top, self.deep, self.since, self.until = top, deep, since, until


class ScanReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.ignored = {*IGNORED, *filter(None, options.get("ignore", "").split(","))}
        limit = options.get("max_file_size_mb", "500")
        self.most = None if float(limit) == float("inf") else int(float(limit) * MB)
        self.limit = limit
        self.links = options.get("follow_symlinks", "false").lower() == "true"
        self.hidden = options.get("include_hidden", "false").lower() == "true"
        self.wanted = Wanted(options.get("wanted"), NAMES)

    def leads_on(self, path: str) -> bool:
        """Whether rows that are wanted may lie below a directory."""
        inside = os.path.relpath(path, self.root) + "/"
        return path == self.root or all(inside.startswith(p) or p.startswith(inside) for p in self.wanted.of("relative_path", "starts")) and all(p.startswith(inside) for p in self.wanted.of("relative_path", "="))

    def partitions(self) -> list[InputPartition]:
        """Whole trees, and the own files of directories over them."""
        parts, level = [], [self.root]
        for _ in range(DEPTH):
            if not level or len(parts) + len(level) >= PARTS:
                break
            parts += [Tree(top, False) for top in level]
            level = [e.path for top in level for e in self.inside(top) if e.is_dir(follow_symlinks=False) and not self.pruned(e.name) and self.leads_on(e.path)]
        return parts + [Tree(top, True) for top in level]

    def inside(self, top: str) -> list[os.DirEntry]:
        try:
            return sorted(os.scandir(top), key=lambda e: e.name)
        except OSError:
            return []  # its own partition tells why

    def pruned(self, name: str) -> bool:
        return name.startswith(".") and not self.hidden or name in self.ignored

    def read(self, partition: Tree) -> Iterator[tuple]:
        path = PurePath(os.path.relpath(partition.top, self.root)).parts
        over = [self.root, *(os.path.join(self.root, *path[:i]) for i in range(1, len(path)))][: len(path)]
        for row in self.walk(partition.top, len(path), partition.deep, frozenset(map(os.path.realpath, over))):
            if not self.wanted.conditions or all(self.wanted.fits(n, x) for n, x in zip(NAMES, row, strict=True)):
                yield row

    def skip(self, path: str, reason: str) -> tuple:
        return (path, os.path.relpath(path, self.root), None, None, None, None, None, "skipped", reason)

    def walk(self, top: str, depth: int, deep: bool, over: frozenset) -> Iterator[tuple]:
        if depth > DEPTH:
            yield self.skip(top, "max_depth_exceeded")
            return
        real = os.path.realpath(top)
        if real in over:
            yield self.skip(top, "symlink_cycle")
            return
        try:
            entries = sorted(os.scandir(top), key=lambda e: e.name)
        except PermissionError:
            yield self.skip(top, "permission_denied")
            return
        except OSError as e:
            yield self.skip(top, f"os_error:{e.strerror}")
            return
        for e in entries:
            if e.is_symlink():
                if not self.links:
                    yield self.skip(e.path, "symlink")
                    continue
                if not os.path.exists(e.path):
                    yield self.skip(e.path, "broken_or_circular_symlink")
                    continue
            if e.is_dir():
                if not (deep or e.is_symlink()):
                    if not self.pruned(e.name):
                        continue  # another partition's
                if e.name.startswith(".") and not self.hidden:
                    yield self.skip(e.path, "hidden_directory")
                elif e.name in self.ignored:
                    yield self.skip(e.path, "ignored_directory")
                elif self.leads_on(e.path):
                    yield from self.walk(e.path, depth + 1, True, over | {real})
            elif self.looked_at(e.path):
                yield self.file(e.path)

    def looked_at(self, path: str) -> bool:
        """Whether a file's name alone leaves it wanted."""
        if not self.wanted.conditions:
            return True
        suffix = PurePath(path).suffix.lower()
        known = suffix if suffix in CATEGORY_OF else None
        return self.wanted.fits("relative_path", os.path.relpath(path, self.root)) and self.wanted.fits("extension", known) and self.wanted.fits("format_category", CATEGORY_OF.get(suffix))

    def file(self, path: str) -> tuple:
        suffix = PurePath(path).suffix.lower()
        if suffix not in CATEGORY_OF:
            return self.skip(path, f"unsupported_extension:{suffix}")
        try:
            found = os.stat(path)
        except PermissionError:
            return self.skip(path, "permission_denied")
        except OSError as e:
            return self.skip(path, f"os_error:{e.strerror}")
        if not stat.S_ISREG(found.st_mode):
            return self.skip(path, "not_regular_file")
        if not os.access(path, os.R_OK):
            return self.skip(path, "not_readable")
        if self.most is not None and found.st_size > self.most:
            return self.skip(path, f"exceeds_size_limit:{found.st_size / MB:.1f}MB>{self.limit}MB")
        return (path, os.path.relpath(path, self.root), os.path.realpath(path), suffix, CATEGORY_OF[suffix], found.st_size, found.st_mtime, "accepted", None)


class ScanStream(DataSourceStreamReader):
    """Accepted files by the time of their last change, of their bytes or of their place: an offset is such a time in nanoseconds.

    A batch has the files whose change lies between two offsets.  The latest offset is SETTLED seconds ago, so a file that is being written waits for the next one.  Files
    that are gone are not seen.
    """

    def __init__(self, options):
        self.scan = ScanReader(options)

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - int(SETTLED * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Tree(p.top, p.deep, start["changed"], end["changed"]) for p in self.scan.partitions()]

    def read(self, partition: Tree) -> Iterator[tuple]:
        for row in self.scan.read(partition):
            if row[STATUS] == "accepted":
                try:
                    found = os.stat(row[0])
                except OSError:
                    continue  # gone since it was listed
                if partition.since < max(found.st_mtime_ns, found.st_ctime_ns) <= partition.until:
                    yield row

    def commit(self, end: dict) -> None:
        pass


class FileScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options)

    def streamReader(self, schema) -> ScanStream:
        return ScanStream(self.options)


def scan(spark: SparkSession, root: str, max_files: int = 0, only: Iterable[Condition] = (), **options) -> DataFrame:
    """The scan log: a row for each file and each refused directory, status accepted or skipped with its reason.

    Of accepted files with one real path the first by relative path stays; the others are skipped as
    duplicates.  ``only``: conditions that the walk applies, before that: (column, comparison, constant), see ``pushed``.  Those on
    paths keep whole directories shut; those on extensions and kinds leave files without a look at their size and time.  ``max_files`` over 0 keeps the first so many accepted rows and drops those behind.  Options: ignore (comma-separated names),
    max_file_size_mb, follow_symlinks, include_hidden.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if not os.access(root, os.R_OK | os.X_OK):
        raise PermissionError(root)
    ship(spark)
    spark.dataSource.register(FileScan)
    read = spark.read.format("file_scan")
    for name, value in options.items():
        read = read.option(name, ",".join(value) if isinstance(value, (list, tuple, set)) else str(value))
    rows = read.option("wanted", said(only)).load(root)
    again = F.row_number().over(Window.partitionBy("real_path").orderBy("relative_path")) > 1
    accepted = rows.where("status = 'accepted'").withColumn("again", again)
    accepted = accepted.withColumn("status", F.when(F.col("again"), "skipped").otherwise("accepted")).withColumn("reason", F.when(F.col("again"), "duplicate_real_path")).drop("again")
    if max_files > 0:
        accepted = accepted.where("status = 'accepted'").orderBy("relative_path").limit(max_files)
    return accepted.unionByName(rows.where("status <> 'accepted'"))


def stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """Accepted files as they come and change, for ``writeStream``; see ScanStream.  Of files with one real path all are given."""
    ship(spark)
    spark.dataSource.register(FileScan)
    read = spark.readStream.format("file_scan")
    for name, value in options.items():
        read = read.option(name, ",".join(value) if isinstance(value, (list, tuple, set)) else str(value))
    return files(read.load(root))


def files(log: DataFrame) -> DataFrame:
    """Accepted files alone."""
    return log.where("status = 'accepted'").select("absolute_path", "relative_path", "extension", "format_category", "size_bytes", "modified_ts")


def iter_files(spark: SparkSession, root: str, **options) -> Iterator:
    """Accepted files one at a time, a partition fetched when the one before is used up."""
    return files(scan(spark, root, **options)).toLocalIterator()
