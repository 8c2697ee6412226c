"""The listing tables of a snapshot, exploded from its file rows.

Duplicates can only occur within one file, where the extractors already remove
them, so none of these needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routes(index: DataFrame) -> DataFrame:
    rows = index.select("repo", "path", F.posexplode("routes").alias("pos", "r"))
    return rows.select(
        "repo", "r.framework", "r.method", F.col("r.url").alias("path"),
        F.col("path").alias("file"), "pos",
    )


def components(index: DataFrame) -> DataFrame:
    rows = index.select("repo", "path", F.posexplode("components").alias("pos", "c"))
    return rows.select(
        "repo", "c.name", F.col("path").alias("file"), "c.props", "c.client", "c.hooks", "pos"
    )


def db_tables(index: DataFrame) -> DataFrame:
    rows = index.select("repo", "path", F.posexplode("tables").alias("pos", "t"))
    return rows.select(
        "repo", "t.engine", "t.name", "t.columns", F.col("path").alias("source"), "pos"
    )


def exports(index: DataFrame) -> DataFrame:
    rows = index.select("repo", "path", F.posexplode("exports").alias("pos", "e"))
    return rows.select("repo", "path", "pos", "e.name", "e.kind")


def imports(index: DataFrame) -> DataFrame:
    rows = index.select("repo", "path", F.posexplode("imports").alias("pos", "specifier"))
    return rows.select("repo", "path", "pos", "specifier")
