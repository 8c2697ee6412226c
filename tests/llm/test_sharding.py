"""Sharding: a permutation in both directions, and whole tables with awkward rows."""

import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillmap.llm import sharding as sh


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def noise(half, seed, i, size):
    value = 42
    for v in (seed, i, half):
        value = xxhash.xxh64_intdigest(struct.pack("<q", v), value)
    return signed(value) % size


def place(x, n, seed):
    """The network and the cycle walk, number by number."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = x % a, x // a
        for i in range(sh.ROUNDS):
            if i % 2 == 0:
                left = (left + noise(right, seed, i, a)) % a
            else:
                right = (right + noise(left, seed, i, b)) % b
        x = left + right * a
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).select("id", sh.place_of(F.col("id"), n, 5).alias("p"))
    rows = df.withColumn("back", sh.number_at(F.col("p"), n, 5)).collect()
    assert [r.p for r in sorted(rows)] == [place(i, n, 5) for i in range(n)]
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


ROWS = [(1, "a"), (1, "a"), (None, "b"), (2, None), (None, None), (3, ""), (4, "x" * 100_000), (4, "y")]


def test_same_result_under_any_partitioning(spark):
    data = [(i, f"t{i % 7}") for i in range(500)]
    df = spark.createDataFrame(data, "k long, t string")
    one = sorted(sh.shards(df.repartition(1), 7, ["k"]).collect())
    many = sorted(sh.shards(df.repartition(13, "t"), 7, ["k"]).collect())
    assert one == many
    counts = Counter(r.shard for r in one)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in one if r.shard == shard) == list(range(counts[shard]))
    assert [(r.shard, r.slot) for r in one] == [(p % 7, p // 7) for p in (place(i, 500, 1) for i in range(500))]


def test_awkward_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, "k long, t string")
    df = df.select("*", *(F.lit(9).alias(c) for c in ("tie", "at", "part", "start", "row_number", "place")))
    out = sh.shards(df, 3, ["k", "t"]).collect()
    assert Counter((r.k, r.t) for r in out) == Counter(ROWS)
    assert all(r.tie == r.at == r.part == r.start == r.row_number == r.place == 9 for r in out)
    assert sorted(r.shard + 3 * r.slot for r in out) == list(range(len(ROWS)))


def test_empty_table(spark):
    out = sh.shards(spark.createDataFrame([], "k long"), 4, ["k"])
    assert out.columns == ["k", "shard", "slot"] and out.count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "k long, t string")
    sh.write_shards(df, 4, ["k"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select("k", "t", "shard", "slot").collect()) == sorted(sh.shards(df, 4, ["k"]).collect())
