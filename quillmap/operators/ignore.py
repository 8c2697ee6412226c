"""Ignore rules of a repository, applied to its files.

Rules are dealt by the directories they begin with. Those of the root are one pattern that every path of the
repository meets; all others are met only by paths below their directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.globs import any_regex, gitignore_globs, glob_regex, is_supported, literal_directory
from quillmap.plans.joins import join_by_repo


def ignore_globs(files: DataFrame, configs: DataFrame) -> DataFrame:
    """All globs of each repository: root ignore file united with its settings."""
    from_file = files.filter(F.col("path") == ".gitignore").select(
        "repo", gitignore_globs(F.col("content")).alias("file_globs")
    )
    from_config = configs.select("repo", F.col("ignore").alias("user_globs"))
    none = F.array().cast("array<string>")
    return from_file.join(from_config, "repo", "full").select(
        "repo",
        F.array_distinct(
            F.concat(F.coalesce("file_globs", none), F.coalesce("user_globs", none))
        ).alias("globs"),
    )


def ignore_rules(globs: DataFrame) -> DataFrame:
    """``repo, ignored``: the pattern for all paths (``root``), and those for paths ``below`` a directory by its name."""
    rules = globs.select("repo", F.explode(F.filter("globs", is_supported)).alias("glob")).select(
        "repo", literal_directory(F.col("glob")).alias("directory"), glob_regex(F.col("glob")).alias("pattern")
    )
    dealt = rules.groupBy("repo", "directory").agg(any_regex(F.array_sort(F.collect_set("pattern"))).alias("pattern"))
    root = F.max(F.when(F.col("directory") == "", F.col("pattern")))
    below = F.collect_list(F.when(F.col("directory") != "", F.struct("directory", "pattern")))
    return dealt.groupBy("repo").agg(F.struct(root.alias("root"), F.map_from_entries(below).alias("below")).alias("ignored"))


def rejected_globs(globs: DataFrame) -> DataFrame:
    """Globs with groups in parentheses, which are not applied."""
    return globs.select("repo", F.explode(F.filter("globs", lambda g: ~is_supported(g))).alias("glob"))


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files no rule matches. Narrow rows only: keep file text out of this join."""
    return without_ignored(join_by_repo(files, rules, spread="path")).drop("ignored")


def _directories(path: Column) -> Column:
    names = F.split(path, "/")
    return F.when(F.size(names) > 1, F.transform(
        F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/")
    )).otherwise(F.array().cast("array<string>"))


def without_ignored(joined: DataFrame) -> DataFrame:
    # regexp_instr keeps the last compiled pattern; rlike would compile per row.
    path, below = F.col("path"), F.col("ignored.below")
    hit = F.regexp_instr(path, F.col("ignored.root")) > 0
    deeper = F.when(F.size(below) > 0, F.exists(_directories(path), lambda d: F.regexp_instr(path, below[d]) > 0))
    return joined.filter(~(F.coalesce(hit, F.lit(False)) | F.coalesce(deeper, F.lit(False))))
