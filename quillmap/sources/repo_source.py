"""Repositories as a Spark data source: ``spark.read.format("repo_files")``.

Options ``repo.<name>`` give the root of each repository as a URI. Filters on path and repository are taken over
before anything is read: they decide which directories are entered and which files are opened. Each
repository is read by ``splits`` tasks, among which its files are dealt by a checksum of the path.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringContains, StringEndsWith, StringStartsWith,
)

from quillmap.sources.files import PRUNED, _open, _read_text, list_directory

SCHEMA = "repo string, path string, mtime timestamp, content string"
_SETTING = "spark.sql.python.filterPushdown.enabled"
_BATCH_BYTES = 32 << 20

Test = Callable[[str], bool]


def _test(condition: Filter) -> tuple[str, Test] | None:
    """The column and the test of a filter that can be decided by name, else None."""
    if isinstance(condition, Not):
        inner = _test(condition.child)
        return inner and (inner[0], lambda v: not inner[1](v))
    tests: dict[type, Callable[[Filter], Test]] = {
        EqualTo: lambda f: lambda v: v == f.value,
        In: lambda f: lambda v: v in f.value,
        StringStartsWith: lambda f: lambda v: v.startswith(f.value),
        StringEndsWith: lambda f: lambda v: v.endswith(f.value),
        StringContains: lambda f: lambda v: f.value in v,
    }
    made = tests.get(type(condition))
    if made is None or condition.attribute not in (("repo",), ("path",)):
        return None
    return condition.attribute[0], made(condition)


def _beginning(condition: Filter) -> str | None:
    """What all paths that pass the filter begin with."""
    if getattr(condition, "attribute", None) == ("path",) and isinstance(condition, (EqualTo, StringStartsWith)):
        return condition.value
    return None


class _Part(InputPartition):
    def __init__(self, repo: str, root: str, split: int) -> None:
        self.repo, self.root, self.split = repo, root, split


class RepoFilesReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], splits: int) -> None:
        self.roots, self.splits = roots, splits
        self.tests: dict[str, list[Test]] = {"repo": [], "path": []}
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            found = _test(condition)
            if found is None:
                yield condition
                continue
            self.tests[found[0]].append(found[1])
            if (start := _beginning(condition)) is not None:
                self.beginnings.append(start)

    def partitions(self) -> list[InputPartition]:
        chosen = {r: root for r, root in self.roots.items() if all(t(r) for t in self.tests["repo"])}
        return [_Part(r, root, k) for r, root in sorted(chosen.items()) for k in range(self.splits)] or [_Part("", "", -1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.split < 0:
            return
        fs, top = _open(partition.root)
        top = top.rstrip("/")
        names, paths, mtimes, contents, size = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([
                pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(mtimes, pa.timestamp("us", "UTC")),
                pa.array(contents, pa.string()),
            ], ["repo", "path", "mtime", "content"])

        pending = [top or "/"]
        while pending:
            files, inner = list_directory(fs, pending.pop(), PRUNED)
            pending += [d for d in inner if self._entered(d[len(top):].lstrip("/") + "/")]
            for e in files:
                path = e.path[len(top):].lstrip("/").replace("\\", "/")
                if zlib.crc32(path.encode()) % self.splits != partition.split or not all(t(path) for t in self.tests["path"]):
                    continue
                content = _read_text(fs, e.path)
                if content is None:
                    continue
                for column, value in zip((names, paths, mtimes, contents), (partition.repo, path, e.mtime, content)):
                    column.append(value)
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield batch()
                    names, paths, mtimes, contents, size = [], [], [], [], 0
        if names:
            yield batch()

    def _entered(self, directory: str) -> bool:
        """Whether a path below the directory can begin as all filters ask."""
        return all(directory.startswith(b) or b.startswith(directory) for b in self.beginnings)


class RepoFilesSource(DataSource):
    """``repo, path, mtime, content`` of the readable files of repositories."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RepoFilesReader:
        roots = {k[len("repo."):]: v for k, v in self.options.items() if k.startswith("repo.")}
        return RepoFilesReader(roots, int(self.options.get("splits", "4")))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed over to it."""
    spark.conf.set(_SETTING, "true")
    spark.dataSource.register(RepoFilesSource)
