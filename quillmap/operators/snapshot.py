"""File index snapshots: building, carrying purposes over, drift, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx

KEY = ["repo", "path"]


def carry_over(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current files with the purposes of the previous snapshot.

    ``state`` tells reused files from changed and new ones. Structural columns
    always come from the current extraction.
    """
    before = previous.select(
        *KEY,
        F.col("hash").alias("old_hash"),
        F.col("purpose"),
        F.col("purpose_stale"),
        F.lit(True).alias("known"),
    )
    same = F.col("hash") == F.col("old_hash")
    known = F.col("known").isNotNull()
    state = F.when(known & same, "reused").when(known, "changed").otherwise("new")
    stale = (
        F.when(known & same, F.coalesce("purpose_stale", F.lit(False)))
        .when(known, F.col("purpose").isNotNull())
        .otherwise(F.lit(False))
    )
    return (
        current.join(before, KEY, "left")
        .withColumn("state", state)
        .withColumn("purpose_stale", stale)
        .drop("old_hash", "known")
    )


def first_snapshot(current: DataFrame) -> DataFrame:
    return current.select(
        "*",
        F.lit(None).cast("string").alias("purpose"),
        F.lit(False).alias("purpose_stale"),
        F.lit("new").alias("state"),
    )


def run_counters(carried: DataFrame) -> DataFrame:
    """Parsed and reused files per repository."""
    return carried.groupBy("repo").agg(
        F.count_if(F.col("state") != "reused").alias("parsed"),
        F.count_if(F.col("state") == "reused").alias("reused"),
    )


def count_errors(listed: DataFrame, read: DataFrame) -> DataFrame:
    """Listed paths whose text could not be read, per repository."""
    return listed.join(read.select(*KEY), KEY, "left_anti").groupBy("repo").agg(
        F.count("*").alias("errors")
    )


def repo_stats(index: DataFrame) -> DataFrame:
    """Files walked, files indexed and lines; ``loc`` is NULL for an unread file."""
    return index.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.count("loc").alias("indexed_files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"),
    )


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every path of either side with its status: same, modified, new or deleted."""
    c = current.select(*KEY, F.col("hash").alias("new_hash"))
    p = previous.select(*KEY, F.col("hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "same")
        .otherwise("modified")
    )
    return c.join(p, KEY, "full").select(*KEY, status.alias("status"))


def deleted_paths(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select(*KEY).join(current.select(*KEY), KEY, "left_anti")


def drift(current: DataFrame, previous: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changed paths per repository; -1 for a repository without a snapshot."""
    changed = compare(current, previous).groupBy("repo").agg(
        F.count_if(F.col("status") != "same").alias("changed")
    )
    have = snapshots.select("repo").distinct().withColumn("indexed", F.lit(True))
    return changed.join(have, "repo", "full").select(
        "repo",
        F.when(F.col("indexed").isNull(), F.lit(-1))
        .otherwise(F.coalesce("changed", F.lit(0)))
        .cast("bigint")
        .alias("changed"),
    )


def freshness(files: DataFrame, indexed_at: DataFrame) -> DataFrame:
    """``no index``, ``stale`` or ``fresh`` by the newest file below the source roots."""
    below_root = F.substring_index("path", "/", 1).isin(fx.FRESHNESS_ROOTS) & F.contains(
        F.col("path"), F.lit("/")
    )
    newest = files.groupBy("repo").agg(F.max(F.when(below_root, F.col("mtime"))).alias("newest"))
    verdict = (
        F.when(F.col("indexed_at").isNull(), "no index")
        .when(F.col("newest") > F.col("indexed_at"), "stale")
        .otherwise("fresh")
    )
    return newest.join(indexed_at.select("repo", "indexed_at"), "repo", "full").select(
        "repo", verdict.alias("freshness")
    )
