"""The task board as a fold over task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import icu, trim
from quillmap.plans.joins import first_per_key, join_by_key, number_rows

_TEXTS = "array<string>"


def suited_agents(listed: Column) -> Column:
    agents = F.filter(F.transform(F.split(listed, ","), trim), lambda a: a != "")
    return F.coalesce(agents, F.array().cast(_TEXTS))


def task_number(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"^t-(\d+)\z", 1).try_cast("bigint")


def highest_numbers(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("repo").agg(
        F.coalesce(F.max(task_number(F.col("id"))), F.lit(0)).alias("highest")
    )


def task_id(number: Column) -> Column:
    return F.format_string("t-%03d", number)


def added_tasks(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Open tasks from ``add`` events, numbered on from the existing ones."""
    adds = events.filter(F.col("action") == "add").select("repo", "seq", "title", "suited")
    numbered = number_rows(adds, ["repo"], "seq", "n")
    if existing is not None:
        numbered = join_by_key(numbered, highest_numbers(existing), ["repo"], spread="seq")
    else:
        numbered = numbered.withColumn("highest", F.lit(0))
    return numbered.select(
        "repo",
        task_id((F.coalesce("highest", F.lit(0)) + F.col("n")).cast("bigint")).alias("id"),
        "title",
        suited_agents(F.col("suited")).alias("suited"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("claimed_by"),
        F.lit("").alias("notes"),
        F.array().cast(_TEXTS).alias("deps"),
        F.col("seq").alias("add_seq"),
    )


def _changes(events: DataFrame) -> DataFrame:
    return events.filter(F.col("action").isin("claim", "done")).select(
        "repo", "seq", "action", F.col("task_id").alias("id"), "by"
    )


def rejected_events(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Changes of a task id that was not there yet at that point."""
    known = tasks.select("repo", "id", "add_seq")
    late = F.col("add_seq").isNull() | (F.col("seq") <= F.col("add_seq"))
    joined = join_by_key(_changes(events), known, ["repo", "id"], spread="seq")
    return joined.filter(late).drop("add_seq")


def fold_board(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks after all valid changes: the last change decides the status, the last claim the claimer.

    Changes are folded per id before they meet the tasks. If the last one came
    before its task was added, then so did all others, so it is enough to
    compare that one.
    """
    claim_seq = F.when(F.col("action") == "claim", F.col("seq"))
    claimer = F.coalesce(F.nullif(F.col("by"), F.lit("")), F.lit(fx.DEFAULT_AGENT))
    folded = _changes(events).groupBy("repo", "id").agg(
        F.max("seq").alias("last_seq"),
        F.max_by("action", "seq").alias("last_action"),
        F.max(claim_seq).alias("claim_seq"),
        F.max_by(claimer, claim_seq).alias("claimer"),
    )

    def counts(seq: str) -> Column:
        return F.col(seq).isNotNull() & (F.col("add_seq").isNull() | (F.col(seq) > F.col("add_seq")))

    last = F.when(F.col("last_action") == "claim", "claimed").otherwise(F.col("last_action"))
    return (
        tasks.join(folded, ["repo", "id"], "left")
        .withColumn("status", F.when(counts("last_seq"), last).otherwise(F.col("status")))
        .withColumn("claimed_by", F.when(counts("claim_seq"), F.col("claimer")).otherwise(F.col("claimed_by")))
        .drop("last_seq", "last_action", "claim_seq", "claimer", "add_seq")
    )


def _after(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value)).otherwise("")


def _list_after(prefix: str, items: Column, suffix: str = "") -> Column:
    text = F.concat(F.lit(prefix), F.array_join(items, ", "), F.lit(suffix))
    return F.when(F.size(items) > 0, text).otherwise("")


def status_rank() -> Column:
    order = F.array(*[F.lit(s) for s in fx.TASK_STATUSES])
    return F.array_position(order, F.col("status")).cast("int")


def board_lines(tasks: DataFrame) -> DataFrame:
    """The board as ordered rows ``repo, rank, id, text``; empty statuses have no heading."""
    known = tasks.withColumn("rank", status_rank()).filter(F.col("rank") > 0)
    line = F.concat(
        F.lit("- **"), F.col("id"), F.lit("** "), F.col("title"),
        _after(" — @", F.col("claimed_by")),
        _list_after(" _(suited: ", F.col("suited"), ")_"),
        _list_after(" — deps: ", F.col("deps")),
    )
    items = known.select("repo", "rank", "id", line.alias("text"))
    headings = known.groupBy("repo", "rank", "status").agg(F.count("*").alias("tasks"))
    heads = tasks.select("repo").distinct()
    return (
        heads.select(
            "repo", F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit(fx.BOARD_HEAD).alias("text")
        )
        .unionByName(
            headings.select(
                "repo", "rank", F.lit("").alias("id"),
                F.concat(F.lit("\n## "), F.col("status")).alias("text"),
            )
        )
        .unionByName(items)
    )


def status_counts(tasks: DataFrame) -> DataFrame:
    return (
        tasks.withColumn("rank", status_rank())
        .filter(F.col("rank") > 0)
        .groupBy("repo", "rank", "status")
        .agg(F.count("*").alias("tasks"))
    )


def unfinished_tasks(tasks: DataFrame) -> DataFrame:
    """The list view: everything that is not done."""
    line = F.concat(
        F.col("id"), F.lit(" "), F.col("status"), F.lit(" "), F.col("title"),
        _list_after(" [", F.col("suited"), "]"), _after(" @", F.col("claimed_by")),
    )
    return tasks.filter(F.col("status") != "done").select("repo", "id", line.alias("text"))


def open_tasks(tasks: DataFrame) -> DataFrame:
    """The bundle view: only open and claimed tasks."""
    return tasks.filter(F.col("status").isin("open", "claimed"))


def bundle_tasks(tasks: DataFrame) -> DataFrame:
    """The first open tasks of each repository, one line each."""
    first = first_per_key(
        open_tasks(tasks), ["repo"], [icu(F.col("id"))], fx.LISTED_TASKS, spread="id"
    )
    line = F.concat(
        F.lit("- "), F.col("id"), F.lit(" "), F.col("title"),
        F.lit(" ["), F.array_join("suited", ","), F.lit("]"),
        F.when(
            F.coalesce("claimed_by", F.lit("")) != "",
            F.concat(F.lit(" (claimed by "), F.col("claimed_by"), F.lit(")")),
        ).otherwise(""),
    )
    return first.select("repo", "rank", "id", line.alias("line"))


def tasks_text(tasks: DataFrame) -> DataFrame:
    lines = bundle_tasks(tasks).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines")
    )
    block = F.concat(
        F.lit("### Open tasks\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    )
    return lines.select("repo", block.alias("text"))
