"""Reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows get their global number from one sort (``row_numbers``). A Feistel network
over the grid a x b, with a * b just above the number of rows n, permutes the
numbers; values of n or more walk the cycle on until they are below n. Place p of
the permutation is slot ``p div shards`` of shard ``p mod shards``, so counts differ
by one at most, slots have no gaps, and both directions can be computed for any
number without a table: ``place_of`` and ``number_at``.

Only column expressions are used. The sort moves the narrow ordering columns,
not the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import fresh, query, table, written

ROUNDS = 6
#: Steps of a cycle walk. Up to n = 4096 fewer values than this lie at or above n; beyond,
#: a step stays outside with a chance below 1 in 64, so a longer walk does not occur. It would
#: end the job with an error, never with a lost row.
WALK = 64


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def _noise(half: Column, seed: int, i: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), F.lit(i).cast("bigint"), half), F.lit(size).cast("bigint"))


def _halves(x: Column, a: int) -> list[Column]:
    return [F.pmod(x, F.lit(a).cast("bigint")), F.call_function("div", x, F.lit(a).cast("bigint"))]


def _turn(x: Column, n: int, seed: int, rounds: list[int], sign: int) -> Column:
    """The network once, or its inverse: even rounds move the half below a, odd ones that below b."""
    sizes = _grid(n)
    halves = _halves(x, sizes[0])
    for i in rounds:
        moved, other = i % 2, 1 - i % 2
        shift = _noise(halves[other], seed, i, sizes[moved]) * F.lit(sign)
        halves[moved] = F.pmod(halves[moved] + shift, F.lit(sizes[moved]).cast("bigint"))
    return halves[0] + halves[1] * F.lit(sizes[0]).cast("bigint")


def _walked(x: Column, n: int, turn: Callable[[Column], Column]) -> Column:
    """Turn until the value is below n; the walk is evaluated only where the first turn is not."""
    once = turn(x)
    walk = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)), once, lambda at, _: F.when(at < n, at).otherwise(turn(at))
    )
    end = F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("bigint"))
    return F.when(once < n, once).otherwise(end)


def place_of(number: Column, n: int, seed: int) -> Column:
    """The place, 0 to n - 1, of a global row number."""
    return _walked(number.cast("bigint"), n, lambda x: _turn(x, n, seed, list(range(ROUNDS)), 1))


def number_at(place: Column, n: int, seed: int) -> Column:
    """The global row number at a place: the inverse of ``place_of``."""
    return _walked(place.cast("bigint"), n, lambda x: _turn(x, n, seed, list(range(ROUNDS))[::-1], -1))


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with the rank of each row in the order of the given columns, from 0, and the number of rows.

    One range exchange and sort; a written table fixes which row came where, so lost
    executors cannot change a number. Rows equal in all order columns are told apart by
    a random column, so even a third of all rows with one key spread over many ranges;
    which of them gets which number is not defined. Only one row per range meets
    in one task to sum the offsets.
    """
    tie, at, part, start = fresh(df.columns + [name], "tie", "at", "part", "start")
    keys = [*order, tie]
    ranged = df.withColumn(tie, F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(ranged.withColumn(at, F.monotonically_increasing_id()).drop(tie), "row-numbers")
    # The id is the number of the range in the upper 31 bits and the place in it in the lower 33.
    kept = kept.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias(start))
    n = counts.agg(F.coalesce(F.sum(start), F.lit(0))).first()[0]
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    # One row per range of the sort, whose number the session's partitions bound.
    out = kept.join(F.broadcast(starts), part)
    return out.withColumn(name, F.col(start) + F.col(at)).select(*df.columns, name), n


def shards(df: DataFrame, count: int, order: list[str], seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (0 to count - 1) and ``slot`` (gapless from 0) of each row.

    Args:
        df: rows of any columns; those named ``shard`` or ``slot`` are replaced.
        count: number of shards; some stay empty if there are fewer rows.
        order: orderable columns that fix the global row number. Nulls sort first.
        seed: another seed gives another shuffle.

    An empty table gives an empty table. The same rows, order, seed and count give the
    same result under any partitioning of the input.
    """
    df = df.drop("shard", "slot")
    (number,) = fresh(df.columns, "row_number")
    numbered, n = row_numbers(df, order, number)
    place = place_of(F.col(number), max(n, 1), seed)
    (at,) = fresh(df.columns, "place")
    return (
        numbered.withColumn(at, place)
        .withColumn("shard", F.pmod(at, F.lit(count)).cast("int"))
        .withColumn("slot", F.call_function("div", F.col(at), F.lit(count).cast("bigint")))
        .drop(at, number)
    )


def write_shards(df: DataFrame, count: int, order: list[str], path: str, seed: int = 1) -> None:
    """Whole rows into ``path/shard=<k>`` in slot order; moves the rows once more, by shard and slot."""
    shards(df, count, order, seed).repartitionByRange("shard", "slot").sortWithinPartitions(
        "shard", "slot"
    ).write.mode("overwrite").partitionBy("shard").parquet(path)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the law ``rows``; null texts count as no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shards(rows, 40, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
