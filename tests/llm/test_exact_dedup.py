"""Exact deduplication: groups by full bytes, also where digests collide."""

from pyspark.sql import functions as F

from quillmap.llm import exact_dedup as ed

ROWS = [(1, "a"), (7, "a"), (3, "b"), (4, None), (5, ""), (6, "ab"), (8, "ba"), (9, "c" * 200_000), (10, "c" * 200_000)]


def by_bytes(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    return groups


def outcome(df, **more):
    return sorted((r.id, r.keep_id, r.group_size, r.kept) for r in ed.decisions(df, **more).collect())


def expected(rows):
    groups = by_bytes(rows)
    return sorted((k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""])) for k, t in rows)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert outcome(df) == expected(ROWS)


def test_digests_that_collide_are_told_apart(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    weak = lambda text: F.length(text).cast("string").cast("binary")
    assert outcome(df, digest=weak) == expected(ROWS)


def test_repeated_rows_and_null_identifiers_leave_one(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at_file", F.lit("mine"))
    df.repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = ed.decisions(docs).collect()
    kept = [(r.id, r.group_size) for r in found if r.kept]
    assert len(found) == len(rows) and sorted(kept, key=str) == sorted([(1, 3), (None, 2), (2, 1)], key=str)
    stay = ed.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert sorted((r.text, r.at_file) for r in stay.collect()) == [("a", "mine"), ("b", "mine"), ("z", "mine")]


def test_empty_table(spark):
    assert ed.decisions(spark.createDataFrame([], "doc_id long, text string")).count() == 0
