"""Exact deduplication by a stream over keyed state.

Rows are staged as narrow keys: digest, identifier and a locator of the content.
A stream over the staged keys holds, per digest and without expiry, the identifier
and locator of the row that stays and the number of rows seen. The state is kept on
disk (RocksDB) and checkpointed in the shared folder. What the stream reports are hits:
digests seen more than once. Only rows of hits have their full bytes read again and
compared, by grouping on the text itself, so two texts with one digest are never merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import fresh, query, small_side, table, written
from quillmap.plans.storage import fresh_folder

#: Bytes of staged keys that one micro-batch takes.
BATCH_BYTES = 8 << 30

_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Else each state partition reserves megabytes of disk for its log files beforehand.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_locator(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with the file and row that hold each row; for rows that come from no
    file, no file and a number that holds as long as the plan of ``docs`` does."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.select("*", F.lit(None).cast("string").alias(file), F.monotonically_increasing_id().alias(row))


def _contents(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    file, row = fresh(docs.columns, "at_file", "at_row")
    content = F.coalesce(F.col(text), F.lit(""))
    located = with_locator(docs, file, row)
    return located.select(
        digest(content).alias("digest"),
        F.struct(F.col(doc_id).alias("id"), F.col(file).alias("file"), F.col(row).alias("row")).alias("at"),
        content.alias("content"),
    )


def _hits(spark: SparkSession, staged: str, schema) -> DataFrame:
    """Digests that the stream over the staged keys saw more than once."""
    out, checkpoint = fresh_folder(spark, "dedup-hits"), fresh_folder(spark, "dedup-state")
    hits = "digest binary, copies bigint"
    spark.createDataFrame([], hits).write.parquet(f"{out}/batch=-1")

    def report(changed: DataFrame, batch: int) -> None:
        seen = changed.where("copies > 1").select("digest", "copies")
        seen.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in _STATE_SETTINGS}
    try:
        for k, v in _STATE_SETTINGS.items():
            spark.conf.set(k, v)
        keys = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(staged)
        state = keys.groupBy("digest").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        run = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(report).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(hits).parquet(out).select("digest").distinct()


def decisions(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: ``id, file, row, digest, keep_id, group_size, kept``.

    Texts are equal when all their bytes are; null counts as empty. Of equal texts the
    row with the largest identifier stays (null is the least); of repeated rows
    with the same identifier the last by locator, so exactly one row of a group stays.
    An empty table gives an empty table. Other columns are neither read nor changed.
    """
    spark = docs.sparkSession
    contents = _contents(docs, text, doc_id, digest)
    folder = fresh_folder(spark, "dedup-keys")
    contents.select("digest", "at").write.parquet(folder)
    keys = spark.read.parquet(folder)

    hits = written(_hits(spark, folder, keys.schema), "dedup-hit-keys")
    suspects = contents.join(small_side(hits), "digest", "left_semi")
    # Grouping by the text compares full bytes; copies meet partly before the shuffle.
    equal = suspects.groupBy("digest", "content").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    groups = written(equal.select("digest", "keeper", "copies"), "dedup-groups")
    texts = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keeper").alias("keeper"), F.max("copies").alias("copies"))
    texts = written(texts, "dedup-digests")

    plain = texts.where("texts = 1 and copies > 1").select("digest", "keeper", "copies")
    out = keys.join(small_side(plain), "digest", "left")
    shared = texts.where("texts > 1").select("digest")
    if not shared.isEmpty():
        # Different texts with one digest: their rows are told apart by the text.
        rows = contents.join(small_side(shared), "digest", "left_semi")
        named = rows.join(
            rows.groupBy("digest", "content").agg(F.max("at").alias("other_keeper"), F.count(F.lit(1)).alias("other_copies")),
            ["digest", "content"],
        ).select("at", "other_keeper", "other_copies")
        out = out.join(written(named, "dedup-collisions"), "at", "left")
        out = out.withColumn("keeper", F.coalesce("other_keeper", "keeper"))
        out = out.withColumn("copies", F.coalesce("other_copies", "copies"))
    keeper = F.coalesce("keeper", "at")
    return out.select(
        F.col("at.id").alias("id"), F.col("at.file").alias("file"), F.col("at.row").alias("row"), "digest",
        keeper["id"].alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("at").eqNullSafe(keeper).alias("kept"),
    )


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    file, row = fresh(docs.columns, "at_file", "at_row")
    gone = decisions(docs, text, doc_id).where("not kept")
    gone = written(gone.select(F.col("file").alias(file), F.col("row").alias(row)), "dedup-dropped")
    located = with_locator(docs, file, row)
    match = located[file].eqNullSafe(gone[file]) & (located[row] == gone[row])
    return located.join(small_side(gone), match, "left_anti").drop(file, row)


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
           sha256(t) AS text_sha256
    FROM d JOIN g USING (t)"""


@query("op4_exact_dedup", ORACLE)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
