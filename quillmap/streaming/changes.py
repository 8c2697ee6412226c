"""Keeping an index fresh from a stream of file changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmap import fixed_values as fx
from quillmap.operators import ignore, snapshot
from quillmap.operators.extract.base import Extractor
from quillmap.operators.extract.registry import BUILT_IN, apply_gates, extract_ungated
from quillmap.plans.joins import earlier_ranges, join_by_key, with_ranges
from quillmap.plans.storage import materialize
from quillmap.sources.files import source_files
from quillmap.streaming.parts import OPEN_PARTS, PART, BurstParts

KEY = ["repo", "path"]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def without_noise(changes: DataFrame) -> DataFrame:
    """Drop changes without a path or below tool folders (by substring)."""
    quiet = F.col("path").isNotNull()
    for word in fx.WATCH_NOISE:
        quiet = quiet & ~F.contains(F.col("path"), F.lit(word))
    return changes.filter(quiet)


def bursts(changes: DataFrame, gap: str = fx.DEBOUNCE, buckets: int = 64) -> DataFrame:
    """One row per burst of changes of a repository: ``repo, first_change, last_change, changes``.

    A session window sorts all changes of a repository in one task. Here they
    are cut into time ranges: only the ends of the ranges of a repository, at
    most one pair per range, have to meet to tell whether a burst goes on.
    """
    points = without_noise(changes).select(
        "repo", F.col("ts").alias("first_change"), F.col("ts").alias("last_change"), F.lit(1).cast("bigint").alias("changes")
    )
    return merged_bursts(points, gap, buckets)


def merged_bursts(parts: DataFrame, gap: str = fx.DEBOUNCE, buckets: int = 64) -> DataFrame:
    """Bursts of which ``parts`` are parts in any overlap; a part that begins within ``gap`` of an earlier one goes on."""
    ranged = with_ranges(parts, F.unix_micros(F.col("first_change").cast("timestamp")), buckets)
    keys = ["repo", "_range"]
    ends = ranged.groupBy(*keys).agg(F.max("last_change").alias("_last"))
    before = ends.select(*keys, F.max("_last").over(earlier_ranges(["repo"])).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("first_change", "last_change")
    reached = F.max("last_change").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    previous = F.greatest(reached, F.col("_before"))
    starts = F.when(F.col("first_change") <= previous + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    marked = ranged.join(before, keys).withColumn("_starts", starts)
    counted = marked.withColumn(
        "_inside", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = counted.groupBy(*keys).agg(F.sum("_starts").alias("_total"))
    offset = F.coalesce(F.sum("_total").over(earlier_ranges(["repo"])), F.lit(0))
    offsets = totals.select(*keys, offset.alias("_offset"))
    return (
        counted.join(offsets, keys)
        .groupBy("repo", (F.col("_inside") + F.col("_offset")).alias("_burst"))
        .agg(
            F.min("first_change").alias("first_change"),
            F.max("last_change").alias("last_change"),
            F.sum("changes").alias("changes"),
        )
        .drop("_burst")
    )


def stream_bursts(
    changes: DataFrame, path: str, checkpoint: str, gap: str = fx.DEBOUNCE,
    lateness: str = "10 seconds", splits: int = 8,
) -> StreamingQuery:
    """Keep bursts of all changes available now: finished parts of bursts in ``path``, open ones in the state.

    Each repository is dealt into ``splits`` by path, so that no task has all changes of a busy one; a part is
    a burst within a split. It is finished by a timer on event time when the watermark is past its end by ``gap``.
    """
    spark = changes.sparkSession
    parts = (
        without_noise(changes)
        .withWatermark("ts", lateness)
        .select("repo", F.pmod(F.xxhash64("path"), F.lit(splits)).cast("int").alias("split"), "ts")
        .groupBy("repo", "split")
        .transformWithState(BurstParts(_milliseconds(changes, gap)), PART, outputMode="append", timeMode="eventTime")
    )
    writer = (
        parts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # A query keeps the settings that hold when it starts; other streams of the session do not see them.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _milliseconds(changes: DataFrame, gap: str) -> int:
    row = changes.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {gap}) AS ms").first()
    return row.ms


def streamed_bursts(spark: SparkSession, path: str, checkpoint: str, gap: str = fx.DEBOUNCE, closing: bool = True) -> DataFrame:
    """The bursts that a stream has kept, put together from the parts of all splits.

    ``closing`` adds the parts still open in the state, as at the end of a stream. Without it, and while the stream
    goes on, the last burst of a repository may be a part of what it will be.
    """
    parts = spark.read.schema(PART).parquet(path)
    if closing:
        state = spark.read.format("statestore").option("stateVarName", OPEN_PARTS).load(checkpoint)
        left = state.select(F.col("key.repo").alias("repo"), F.col("list_element.*"))
        parts = parts.unionByName(left)
    times = [F.timestamp_micros(c).alias(c) for c in ("first_change", "last_change")]
    # Reading the state opens all its stores, and putting bursts together reads the parts several times.
    return merged_bursts(materialize(parts.select("repo", *times, "changes"), "burst-parts"), gap)


def current_index(
    spark: SparkSession, path: str, before: int | None = None, keys: DataFrame | None = None
) -> DataFrame | None:
    """The index that the stored batches add up to.

    ``before`` leaves out that batch and later ones; ``keys`` asks for some
    files only, which are then the only ones to be shuffled.
    """
    try:
        rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except Exception as error:  # no batch stored yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    rows = rows.withColumn("batch", F.col("batch").cast("bigint"))
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if keys is not None:
        rows = rows.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    newest = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*KEY, "batch"]).filter(~F.col("deleted")).drop("batch", "deleted")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last state of each changed path; ``content`` is NULL for a deleted file."""
    digest = F.sha1(F.coalesce("content", F.lit("")))
    stamped = changes.withColumn("version", F.struct("ts", digest.alias("digest")))
    newest = stamped.groupBy(*KEY).agg(F.max("version").alias("newest"))
    return (
        join_by_key(stamped, newest, KEY, spread="version", how="inner")
        .filter(F.col("version") == F.col("newest"))
        .dropDuplicates(KEY)
        .drop("version", "newest")
        .withColumn("deleted", F.col("content").isNull())
    )


def store_batch(
    changes: DataFrame,
    batch: int,
    path: str,
    settings: DataFrame,
    extractors: Sequence[Extractor] = BUILT_IN,
) -> None:
    """Extract the changed files and store them as one batch.

    Only changed files are read and written. A batch sees the batches before it
    and replaces its own folder, so running it again gives the same result.
    """
    spark = changes.sparkSession
    latest = latest_changes(without_noise(changes))
    rules = ignore.ignore_rules(
        settings.select("repo", F.col("ignore").alias("globs")).filter(F.size("globs") > 0)
    )
    extracted = extract_ungated(source_files(latest.filter(~F.col("deleted"))), extractors)
    current = apply_gates(extracted, settings.join(rules, "repo", "left"), extractors)
    previous = current_index(spark, path, before=batch, keys=changes)
    carried = (
        snapshot.first_snapshot(current)
        if previous is None
        else snapshot.carry_over(current, previous)
    )
    gone = latest.filter(F.col("deleted")).select(*KEY, "deleted")
    (
        carried.withColumn("deleted", F.lit(False))
        .unionByName(gone, allowMissingColumns=True)
        .write.mode("overwrite")
        .parquet(f"{path}/batch={batch}")
    )


def batch_writer(
    path: str, settings: DataFrame, extractors: Sequence[Extractor] = BUILT_IN
) -> Callable[[DataFrame, int], None]:
    def write(changes: DataFrame, batch: int) -> None:
        store_batch(changes, batch, path, settings, extractors)

    return write


def stream_index(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    settings: DataFrame,
    extractors: Sequence[Extractor] = BUILT_IN,
) -> StreamingQuery:
    """Bring the stored index up to date with all changes available now."""
    return (
        changes.writeStream.foreachBatch(batch_writer(path, settings, extractors))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current index to a new place as its only, lowest batch."""
    index = current_index(spark, path)
    if index is not None:
        index.withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(
            f"{target}/batch=-1"
        )
