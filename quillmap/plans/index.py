"""From repository files to a stored snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import short_hash
from quillmap.operators import ignore, snapshot, stack
from quillmap.operators.extract.base import Extractor
from quillmap.operators.extract.registry import BUILT_IN, apply_gates, extract_ungated
from quillmap.plans.storage import materialize
from quillmap.sources.documents import config_or_default
from quillmap.sources.files import source_files


def repo_settings(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Stack and settings, one row per repository: the small side of all gates."""
    stacks = stack.repo_stacks(files)
    return stacks.join(config_or_default(stacks, configs), "repo")


def extract_corpus(
    files: DataFrame,
    settings: DataFrame,
    extractors: Sequence[Extractor] = BUILT_IN,
) -> DataFrame:
    """Extracted rows of all source files that no ignore rule drops.

    The text is read once, by the extraction; ignore rules and gates then meet
    the narrow rows it leaves.
    """
    extracted = extract_ungated(source_files(files), extractors)
    rules = ignore.ignore_rules(ignore.ignore_globs(files, settings))
    return apply_gates(extracted, settings.join(rules, "repo", "left"), extractors)


def build_index(
    files: DataFrame,
    configs: DataFrame,
    previous: DataFrame | None = None,
    extractors: Sequence[Extractor] = BUILT_IN,
) -> tuple[DataFrame, DataFrame]:
    """The new file index and the settings it was built with, both stored."""
    settings = materialize(repo_settings(files, configs), "settings")
    current = extract_corpus(files, settings, extractors)
    index = (
        snapshot.first_snapshot(current)
        if previous is None
        else snapshot.carry_over(current, previous)
    )
    return materialize(index, "index"), settings


def write_snapshot(index: DataFrame, path: str, snapshot_id: str) -> None:
    """Store a snapshot as one partition; writing the same id again replaces it."""
    (
        index.withColumn("snapshot", F.lit(snapshot_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(path)
    )


def current_hashes(files: DataFrame, settings: DataFrame) -> DataFrame:
    """``repo, path, hash`` of the files a fresh index would hold, without extraction."""
    narrow = source_files(files).select("repo", "path", short_hash(F.col("content")).alias("hash"))
    rules = ignore.ignore_rules(ignore.ignore_globs(files, settings))
    return ignore.drop_ignored(narrow, rules)

