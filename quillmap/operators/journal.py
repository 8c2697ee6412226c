"""Handoff notes and decisions, kept as event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import decision_title, or_placeholder
from quillmap.plans.joins import first_per_key, join_by_repo

_NOTE_FIELDS = ["from_agent", "stopped", "next", "gotchas", "files"]


def utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def iso_time(ts: Column) -> Column:
    return F.date_format(utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def latest_handoffs(handoffs: DataFrame) -> DataFrame:
    """The last note of each repository; partial ``max_by`` keeps hot ones cheap."""
    newest = F.max_by(F.struct("ts", "seq", *_NOTE_FIELDS), F.struct("ts", "seq"))
    return handoffs.groupBy("repo").agg(newest.alias("h")).select("repo", "h.*")


def author(from_agent: Column, configured: Column | None = None) -> Column:
    given = [F.nullif(from_agent, F.lit(""))]
    if configured is not None:
        given.append(F.nullif(configured, F.lit("")))
    return F.coalesce(*given, F.lit(fx.DEFAULT_AGENT))


def handoff_body() -> Column:
    fields = [
        ("Where I stopped", "stopped"),
        ("What to do next", "next"),
        ("Gotchas / watch out for", "gotchas"),
        ("Files I touched", "files"),
    ]
    lines = [F.concat(F.lit(f"**{label}:** "), or_placeholder(F.col(c))) for label, c in fields]
    return F.concat(F.lit("# Handoff\n\n"), F.concat_ws("\n\n", *lines), F.lit("\n"))


def handoff_documents(handoffs: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """The current handoff document of each repository as ``repo, doc, front, body``."""
    latest = latest_handoffs(handoffs)
    if configs is None:
        named = latest.withColumn("agent_name", F.lit(None).cast("string"))
    else:
        named = latest.join(configs.select("repo", "agent_name"), "repo", "left")
    front = F.create_map(
        F.lit("updated"), iso_time(F.col("ts")),
        F.lit("fromAgent"), author(F.col("from_agent"), F.col("agent_name")),
    )
    return named.select(
        "repo", F.lit("handoff").alias("doc"), front.alias("front"), handoff_body().alias("body")
    )


def stamp_state(documents: DataFrame, handoff_docs: DataFrame) -> DataFrame:
    """State documents with ``updated`` and ``lastAgent`` of the current handoff."""
    stamps = handoff_docs.select(
        "repo",
        F.create_map(
            F.lit("updated"), F.col("front")["updated"],
            F.lit("lastAgent"), F.col("front")["fromAgent"],
        ).alias("stamp"),
    )
    others = F.map_filter("front", lambda k, _: ~k.isin("updated", "lastAgent"))
    stamped = F.when(F.col("stamp").isNotNull(), F.map_concat(others, F.col("stamp"))).otherwise(
        F.col("front")
    )
    return (
        documents.filter(F.col("doc") == "state")
        .join(stamps, "repo", "left")
        .select("repo", "doc", stamped.alias("front"), "body")
    )


def decision_entry() -> Column:
    return F.concat(
        F.lit("## "), F.date_format(utc(F.col("ts")), "yyyy-MM-dd"), F.lit(" — "),
        decision_title(F.col("text")), F.lit("\n\n"), F.col("text"),
    )


def decision_entries(decisions: DataFrame) -> DataFrame:
    return decisions.select("repo", "ts", "seq", decision_entry().alias("entry"))


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("seq").desc()]


def recent_decisions(decisions: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """The newest decisions of each repository, as many as its settings ask for."""
    if configs is None:
        limited, limit = decisions, fx.DEFAULT_DECISIONS
    else:
        limits = configs.select("repo", "decisions_in_context")
        limited = join_by_repo(decisions, limits, spread="seq")
        limit = F.coalesce("decisions_in_context", F.lit(fx.DEFAULT_DECISIONS))
    kept = first_per_key(limited, ["repo"], newest_first(), limit, spread="seq")
    return kept.select("repo", "ts", "seq", "text", "rank")


def decisions_text(recent: DataFrame) -> DataFrame:
    """One text per repository from its few recent decisions."""
    ranked = recent.select("repo", F.struct("rank", decision_entry().alias("entry")).alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n\n")
    return ranked.groupBy("repo").agg(joined.alias("text"))
