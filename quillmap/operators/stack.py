"""Which stacks a repository uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.sources.documents import read_dependencies


def mapped_dependencies(files: DataFrame) -> DataFrame:
    """``repo, dependency, stack`` for the dependencies that stand for a stack."""
    manifests = files.filter(F.col("path") == "package.json")
    stack_of = F.create_map(*[F.lit(x) for kv in fx.STACK_BY_DEPENDENCY.items() for x in kv])
    named = read_dependencies(manifests).select("repo", F.explode("dependencies").alias("dependency"))
    return named.withColumn("stack", F.try_element_at(stack_of, F.col("dependency"))).filter(
        F.col("stack").isNotNull()
    )


def _by_dependency(dependencies: Column, stack: str) -> Column:
    names = [d for d, s in fx.STACK_BY_DEPENDENCY.items() if s == stack]
    return F.arrays_overlap(dependencies, F.array(*[F.lit(n) for n in names]))


def _by_marker(path: Column, stack: str) -> Column:
    found = path.isin(fx.STACK_MARKER_FILES.get(stack, []))
    for directory, owner in fx.STACK_MARKER_DIRECTORIES.items():
        if owner == stack:
            found = found | (path == directory) | F.startswith(path, F.lit(directory + "/"))
    return found


def _array_of(flags: dict[str, Column]) -> Column:
    names = [F.when(flag, F.lit(name)) for name, flag in flags.items()]
    return F.array_compact(F.array(*names))


def repo_stacks(files: DataFrame) -> DataFrame:
    """``repo, project_name, stack`` for every repository with a file.

    Flags are aggregated with ``max``, so each task sends one row per
    repository; the text column is read only for manifests.
    """
    manifests = read_dependencies(files.filter(F.col("path") == "package.json")).select(
        "repo",
        "name",
        *[_by_dependency(F.col("dependencies"), s).alias(s) for s in fx.STACK_NAMES],
    )
    markers = files.select(
        "repo",
        F.lit(None).cast("string").alias("name"),
        *[_by_marker(F.col("path"), s).alias(s) for s in fx.STACK_NAMES],
    )
    merged = (
        manifests.unionByName(markers)
        .groupBy("repo")
        .agg(F.max("name").alias("name"), *[F.max(s).alias(s) for s in fx.STACK_NAMES])
    )
    return merged.select(
        "repo",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(fx.DEFAULT_PROJECT_NAME)).alias(
            "project_name"
        ),
        _array_of({s: F.col(s) for s in fx.STACK_NAMES}).alias("stack"),
    )
