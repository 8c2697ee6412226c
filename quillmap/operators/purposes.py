"""One-line file purposes: what to ask for, reading answers, applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import clean_answer, trim
from quillmap.sources.documents import parse_json

KEY = ["repo", "path"]

REQUEST_HEAD = (
    "# Files that need a purpose\n\n"
    "For each file, give one line of at most 12 words that says what it does, judging by its\n"
    "path and exported symbols. Answer with a JSON object from path to purpose and nothing else.\n"
)


def stale_files(index: DataFrame) -> DataFrame:
    return index.filter(F.col("purpose").isNull() | F.col("purpose_stale"))


def request_items(index: DataFrame) -> DataFrame:
    """One request item per stale file, all its exports and imports listed."""
    symbols = F.array_join(
        F.transform("exports", lambda e: F.concat(e["name"], F.lit(" ("), e["kind"], F.lit(")"))), ", "
    )
    modules = F.array_join("imports", ", ")
    dash = F.lit("—")
    item = F.concat(
        F.lit("- "), F.col("path"),
        F.lit("\n    exports: "), F.when(symbols == "", dash).otherwise(symbols),
        F.lit("\n    imports: "), F.when(modules == "", dash).otherwise(modules),
    )
    return stale_files(index).select("repo", "path", item.alias("item"))


def request_lines(index: DataFrame) -> DataFrame:
    """Request texts as ordered rows: a head per repository, then its items."""
    items = request_items(index)
    heads = items.select("repo").distinct().select(
        "repo", F.lit("").alias("path"), F.lit(REQUEST_HEAD).alias("text")
    )
    return heads.unionByName(items.withColumnRenamed("item", "text"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """``repo, ts, raw`` to ``repo, path, ts, purpose``; bad JSON and blank texts drop out."""
    answers = responses.select(
        "repo", "ts", parse_json(clean_answer(F.col("raw")), "map<string,string>").alias("answers")
    )
    rows = answers.select("repo", "ts", F.explode("answers").alias("path", "purpose"))
    return rows.withColumn("purpose", trim(F.col("purpose"))).filter(F.col("purpose") != "")


def latest_answers(answers: DataFrame) -> DataFrame:
    return answers.groupBy(*KEY).agg(F.max_by("purpose", F.struct("ts", "purpose")).alias("answer"))


def apply_answers(index: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers overwrite purposes and clear the stale mark; ``applied`` marks the rows."""
    joined = index.join(latest_answers(answers), KEY, "left")
    hit = F.col("answer").isNotNull()
    return (
        joined.withColumn("applied", hit)
        .withColumn("purpose_stale", F.when(hit, F.lit(False)).otherwise(F.col("purpose_stale")))
        .withColumn("purpose", F.coalesce("answer", "purpose"))
        .drop("answer")
    )


def applied_counts(applied: DataFrame) -> DataFrame:
    return applied.groupBy("repo").agg(F.count_if("applied").alias("applied"))
