"""Source files: reading them and deciding which paths count."""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import forward_slashes
from quillmap.plans.joins import tasks
from quillmap.plans.storage import materialize

_ANY_DIRECTORY = "|".join(d.replace(".", r"\.") for d in fx.IGNORED_DIRECTORIES)
_KEPT_EXTENSION = rf"\.(?:{'|'.join(fx.SOURCE_EXTENSIONS)})\z"
_DROPPED = (
    rf"(?:^|/)(?:\.|(?:{_ANY_DIRECTORY})/|(?:{'|'.join(fx.IGNORED_NAME_PATTERNS)})(?:/|\z))"
)


_LISTED = "repo string, path string, root string, file string, mtime timestamp"
_BATCH_BYTES = 32 * 1024 * 1024


#: Directories that no reader of this package looks into. The state folder is not among them.
PRUNED = [d for d in fx.IGNORED_DIRECTORIES if d != fx.STATE_DIRECTORY]


#: Directories that a task lists before it hands those it has still to enter over to others.
SHARE = 2_000

#: Rows of a batch of listed files.
_ROWS = 10_000

_LEVEL = f"{_LISTED}, directory string"


def list_directory(fs: FileSystem, directory: str, pruned: Collection[str]) -> tuple[list[FileInfo], list[str]]:
    """Files of a directory and the directories in it that are to be entered. Links are neither."""
    entries = fs.get_file_info(FileSelector(directory))
    if isinstance(fs, LocalFileSystem):
        entries = [e for e in entries if not os.path.islink(e.path)]
    files = [e for e in entries if e.type == FileType.File]
    return files, [e.path for e in entries if e.type == FileType.Directory and e.base_name not in pruned]


def list_repo_files(repos: DataFrame, pruned: Sequence[str] = PRUNED, share: int = SHARE) -> DataFrame:
    """``repo, root`` to one row per file: ``repo, path, root, file, mtime``.

    Spark's own file sources leave out empty files and all names that start
    with a dot or an underscore, so ignore files and files such as ``_app.tsx``
    would be missing. Here tasks list the directories themselves, on any file system that Arrow
    can open. Directories named in ``pruned`` are not entered, at any depth, and links are not followed.

    The frontier of pending directories is a table: each task lists up to ``share`` directories, and all those of
    its part in any case, and hands the rest over, which is written and dealt out again. So one huge tree is listed by
    all tasks, and small ones in one pass. A directory is handed over once at most, and there are no more passes than
    the deepest tree has levels.

    Only ``root`` is a URI; ``file`` is the plain path on its file system, so names
    may hold brackets, blanks or any other character.
    """
    skipped = frozenset(pruned)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple[FileSystem, str]] = {}
        left = share
        found: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                repo, root = row["repo"], row["root"]
                if root not in opened:
                    fs, top = _open(root)
                    opened[root] = fs, top.rstrip("/")
                fs, top = opened[root]
                given = row["directory"] if row["directory"] is not None else top or "/"
                pending, more = [given], True
                while pending and more:
                    files, inner = list_directory(fs, pending.pop(), skipped)
                    found += [(repo, e.path[len(top):].lstrip("/"), root, e.path, e.mtime, None) for e in files]
                    pending += inner
                    more = left > 0
                    left -= more
                    if len(found) >= _ROWS:
                        yield _level_rows(found)
                        found = []
                found += [(repo, None, root, None, None, d) for d in pending]
        if found:
            yield _level_rows(found)

    frontier = repos.select("repo", "root", F.lit(None).cast("string").alias("directory"))
    found = []
    while True:
        spread = frontier.repartition(tasks(repos), "repo", "root", "directory")
        level = materialize(spread.mapInArrow(expand, _LEVEL), "listed-files")
        found.append(level.filter(F.col("directory").isNull()).drop("directory"))
        frontier = level.filter(F.col("directory").isNotNull()).select("repo", "root", "directory")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.union, found).withColumn("path", forward_slashes(F.col("path")))


_FIELDS = [
    ("repo", pa.string()), ("path", pa.string()), ("root", pa.string()), ("file", pa.string()),
    ("mtime", pa.timestamp("us", "UTC")), ("directory", pa.string()),
]


def _level_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in _FIELDS])


def read_listed_files(listed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``content`` to listed files; NULL where a file cannot be read.

    Paths are spread over tasks first, so one large repository is read by many. Each
    task opens the file system of a root once. Filter ``listed`` by path before to
    read fewer files. Bytes that are not UTF-8 become U+FFFD.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, FileSystem] = {}
        for batch in batches:
            contents: list[str | None] = []
            size = start = 0
            places = zip(batch.column("root").to_pylist(), batch.column("file").to_pylist())
            for i, (root, file) in enumerate(places, 1):
                if root not in opened:
                    opened[root] = _open(root)[0]
                contents.append(_read_text(opened[root], file))
                size += len(contents[-1] or "")
                if size >= _BATCH_BYTES or i == batch.num_rows:
                    done = batch.slice(start, i - start).select(["repo", "path", "mtime"])
                    yield done.append_column("content", pa.array(contents, pa.string()))
                    contents, size, start = [], 0, i

    columns = [F.col("repo"), F.col("path")]
    spread = listed.repartition(partitions or tasks(listed), *columns)
    return spread.select("repo", "path", "mtime", "root", "file").mapInArrow(
        read, "repo string, path string, mtime timestamp, content string"
    )


def _open(uri: str) -> tuple[FileSystem, str]:
    """File system and path of a URI; Hadoop's names for S3 are understood too."""
    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _read_text(fs: FileSystem, path: str) -> str | None:
    try:
        with fs.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", errors="replace")
    except OSError:
        return None


def read_repo_files(repos: DataFrame) -> DataFrame:
    """Readable files of all repositories as ``repo, path, content, mtime``."""
    return read_listed_files(list_repo_files(repos)).filter(F.col("content").isNotNull())


def is_source_path(path: Column) -> Column:
    """Known extension, no ignored directory or name, nothing hidden."""
    return F.rlike(path, F.lit(_KEPT_EXTENSION)) & ~F.rlike(path, F.lit(_DROPPED))


def source_files(files: DataFrame) -> DataFrame:
    return files.filter(is_source_path(F.col("path")))
