"""Running extractors over a corpus: one pass over the text, gates afterwards.

Whether a repository uses a stack, or has an extractor switched off, is decided
on the narrow extracted rows. The text column is therefore never shuffled, and
no table that grows with the number of repositories has to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions import text as t
from quillmap.operators.extract.base import LIST_TYPES, Extractor, FileColumns, empty_list
from quillmap.operators.extract.components import ComponentExtractor
from quillmap.operators.extract.modules import ModuleExtractor
from quillmap.operators.extract.routes import CallRouteExtractor, FileRouteExtractor
from quillmap.operators.extract.schemas import (
    CollectionExtractor,
    DdlExtractor,
    ModelExtractor,
    TypedTableExtractor,
)
from quillmap.operators.ignore import without_ignored
from quillmap.plans.joins import join_by_repo

BUILT_IN: tuple[Extractor, ...] = (
    ModuleExtractor(),
    FileRouteExtractor(),
    CallRouteExtractor(),
    ComponentExtractor(),
    ModelExtractor(),
    DdlExtractor(),
    TypedTableExtractor(),
    CollectionExtractor(),
)


def describe_files(files: DataFrame) -> DataFrame:
    """``repo, path, ext, lang, hash, loc`` and both texts of each file."""
    ext = t.extension(F.col("path"))
    named = files.select("repo", "path", "content", ext.alias("ext"))
    script = F.col("ext").isin(fx.SCRIPT_EXTENSIONS)
    content = F.col("content")
    return named.select(
        "repo",
        "path",
        "ext",
        t.language(F.col("ext")).alias("lang"),
        t.short_hash(content).alias("hash"),
        t.line_count(content).alias("loc"),
        content.alias("raw"),
        F.when(script, t.strip_comments(content)).otherwise(content).alias("clean"),
    )


def _slot(extractor: Extractor, kind: str) -> str:
    return f"{kind}@{extractor.name}"


@lru_cache(maxsize=16)
def _slot_columns(application: str, extractors: tuple[Extractor, ...]) -> tuple[Column, ...]:
    """The expressions of all extractors, built once per Spark application."""
    file = FileColumns(*[F.col(c) for c in ("path", "ext", "raw", "clean")])
    slots = []
    for ex in extractors:
        for kind, value in ex.lists(file).items():
            guarded = F.when(ex.applies(file), value).otherwise(empty_list(kind))
            slots.append(guarded.alias(_slot(ex, kind)))
    return tuple(slots)


def _application(df: DataFrame) -> str:
    return df.sparkSession.sparkContext.applicationId


def extract_ungated(
    files: DataFrame, extractors: Sequence[Extractor] = BUILT_IN
) -> DataFrame:
    """One row per file with one list column per extractor and kind."""
    slots = _slot_columns(_application(files), tuple(extractors))
    return describe_files(files).select("repo", "path", "lang", "hash", "loc", *slots)


def extractor_enabled(toggles: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(toggles, F.lit(name)), F.lit(True))


def _allowed(ex: Extractor) -> Column:
    enabled = extractor_enabled(F.col("extractors"), ex.name)
    if not ex.stacks:
        return enabled
    return enabled & F.arrays_overlap(
        F.coalesce(F.col("stack"), F.array().cast("array<string>")),
        F.array(*[F.lit(s) for s in ex.stacks]),
    )


def apply_gates(
    extracted: DataFrame,
    repos: DataFrame,
    extractors: Sequence[Extractor] = BUILT_IN,
) -> DataFrame:
    """Merge the lists of the extractors that a repository's stack and toggles allow.

    ``repos`` has one row per repository: ``repo, stack, extractors`` and, where
    there are ignore rules, their pattern ``ignored``. All of them take part in
    the same join.
    """
    if "ignored" in repos.columns:
        gates = repos.select("repo", "stack", "extractors", "ignored")
        joined = without_ignored(join_by_repo(extracted, gates, spread="path"))
    else:
        gates = repos.select("repo", "stack", "extractors")
        joined = join_by_repo(extracted, gates, spread="path")
    present = tuple(c for c in extracted.columns if "@" in c)
    merged = _merged_columns(_application(extracted), tuple(extractors), present)
    return joined.select("repo", "path", "lang", "hash", "loc", *merged)


@lru_cache(maxsize=16)
def _merged_columns(
    application: str, extractors: tuple[Extractor, ...], present: tuple[str, ...]
) -> tuple[Column, ...]:
    merged = []
    for kind in LIST_TYPES:
        parts = [
            F.when(_allowed(ex), F.col(f"`{_slot(ex, kind)}`")).otherwise(empty_list(kind))
            for ex in extractors
            if _slot(ex, kind) in present
        ]
        merged.append(reduce(lambda a, b: F.concat(a, b), parts, empty_list(kind)).alias(kind))
    return tuple(merged)
