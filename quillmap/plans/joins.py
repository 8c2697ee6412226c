"""Joins and rankings that stay spread out when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_SALT = "_salt"


def salts(df: DataFrame) -> int:
    """How many ways to split each key; ``spark.quillmap.salts`` on the session."""
    return int(df.sparkSession.conf.get("spark.quillmap.salts", "16"))


def join_by_key(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread: str | Column,
    how: str = "left",
) -> DataFrame:
    """Join many fact rows to at most one dimension row per key.

    Fact rows of a key are split by a hash of ``spread``; each dimension row is
    repeated once per split, so no single task gets all rows of a hot key.
    """
    n = salts(facts)
    spread = F.col(spread) if isinstance(spread, str) else spread
    left = facts.withColumn(_SALT, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    right = dimension.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def join_by_repo(
    facts: DataFrame, dimension: DataFrame, spread: str | Column, how: str = "left"
) -> DataFrame:
    return join_by_key(facts, dimension, ["repo"], spread, how)


def tasks(df: DataFrame) -> int:
    """Into how many parts rows are dealt whose work does not go by their bytes: named, since Spark puts few bytes into one part."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table of narrow rows, with a broadcast hint if a count shows at most ``rows`` of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int | Column,
    spread: str | Column,
) -> DataFrame:
    """The first ``limit`` rows of each key, ranked in two steps.

    Each split of a key is cut to its own first ``limit`` rows before the
    splits meet, so the second step sees at most splits x limit rows per key.
    """
    n = salts(df)
    spread = F.col(spread) if isinstance(spread, str) else spread
    split = df.withColumn(_SALT, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    local = Window.partitionBy(*keys, _SALT).orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = split.withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= limit)
    return (
        kept.withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= limit)
        .drop(_SALT)
    )


def with_ranges(df: DataFrame, order: Column, buckets: int = 64) -> DataFrame:
    """Add ``_range``: the part of the whole table's ``order`` values a row falls into.

    Cut points are approximate quantiles, so there are at most ``buckets`` of
    them on the driver, and a key with many rows spreads over many ranges.
    """
    valued = df.withColumn("_at", order.cast("double"))
    marks = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(valued.approxQuantile("_at", marks, 1 / (4 * buckets))))
    if not cuts:
        return valued.withColumn("_range", F.lit(0)).drop("_at")
    reached = F.array(*[F.when(F.col("_at") >= c, F.lit(1)) for c in cuts])
    return valued.withColumn("_range", F.size(F.array_compact(reached))).drop("_at")


def earlier_ranges(keys: Sequence[str]) -> WindowSpec:
    """All ranges of a key before the current one; a key has few of them."""
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, name: str, buckets: int = 64
) -> DataFrame:
    """``row_number`` per key over a numeric, per-key unique column, without one task per key.

    Rows are numbered within ranges; counts per key and range give each range
    its offset.
    """
    ranged = with_ranges(df, F.col(order), buckets)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(earlier_ranges(keys)), F.lit(0))
    offsets = sizes.withColumn("_offset", offset).drop("_rows")
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumn("_n", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_n") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_n", "_offset")
    )
