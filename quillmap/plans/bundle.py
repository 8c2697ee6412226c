"""Orientation bundles: documents, tasks and the map under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import estimate_tokens, trim
from quillmap.operators import budget as b
from quillmap.operators import listing, tables
from quillmap.operators.board import tasks_text
from quillmap.operators.outline import plan_outline, recent_blocks
from quillmap.operators.snapshot import repo_stats
from quillmap.plans.joins import join_by_key, join_by_repo
from quillmap.plans.storage import materialize

DEFAULT_HEADER = "# Project Context\n"
HINT_INDEXED = "_No state written yet._"
HINT_NEW = "_Not initialized._"


def _priority(name: str) -> Column:
    return F.lit(fx.SECTION_PRIORITIES[name]).alias("priority")


def _section(rows: DataFrame, name: str, body: Column) -> DataFrame:
    return rows.select(
        "repo", _priority(name), F.lit(name).alias("name"), body.alias("body"),
        F.lit(None).cast("string").alias("collapsed"),
    )


def document_sections(documents: DataFrame, settings: DataFrame) -> DataFrame:
    """State, handoff, plan outline and recent decisions from ``repo, doc, body``."""
    text = trim(F.col("body"))
    filled = documents.withColumn("body", text).filter(F.col("body") != "")
    limit = settings.select("repo", "decisions_in_context")

    def of(doc: str) -> DataFrame:
        return filled.filter(F.col("doc") == doc)

    decisions = (
        of("decisions")
        .join(limit, "repo", "left")
        .withColumn(
            "recent",
            recent_blocks(
                F.col("body"),
                F.coalesce("decisions_in_context", F.lit(fx.DEFAULT_DECISIONS)).cast("int"),
            ),
        )
        .filter(F.col("recent") != "")
    )
    body = F.col("body")
    return (
        _section(of("state"), "state", F.concat(F.lit("## Current State\n"), body))
        .unionByName(_section(of("handoff"), "handoff", F.concat(F.lit("## Last Handoff\n"), body)))
        .unionByName(_section(of("plan"), "plan", F.concat(F.lit("## Plan\n"), plan_outline(body))))
        .unionByName(
            _section(decisions, "decisions", F.concat(F.lit("## Recent Decisions\n"), F.col("recent")))
        )
    )


def task_sections(tasks: DataFrame) -> DataFrame:
    return _section(tasks_text(tasks), "tasks", F.concat(F.lit("## Tasks\n"), F.col("text")))


def map_sections(index: DataFrame, settings: DataFrame) -> DataFrame:
    """The heading of the map: stack, number of files and lines."""
    stats = repo_stats(index).join(settings.select("repo", "stack"), "repo", "left")
    stack = F.when(
        F.size("stack") > 0, F.concat(F.lit("**Stack:** "), F.array_join("stack", ", "))
    ).otherwise("")
    body = F.concat(
        F.lit("## Codebase Map\n"), stack, F.lit("\n_"), F.col("indexed_files").cast("string"),
        F.lit(" files, "), F.col("loc").cast("string"), F.lit(" lines_"),
    )
    return _section(stats, "map-head", body)


def _with_budget(rows: DataFrame, settings: DataFrame, fixed: int | None) -> DataFrame:
    if fixed is not None:
        return rows.withColumn("budget", F.lit(fixed).cast("bigint"))
    limits = settings.select("repo", F.col("context_budget").alias("budget"))
    return rows.join(limits, "repo", "left").withColumn(
        "budget", F.coalesce("budget", F.lit(fx.DEFAULT_BUDGET)).cast("bigint")
    )


def index_lines(index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Listing lines of all sections, or only of the ``repo, section`` that are wanted."""

    def of(section: str) -> DataFrame:
        if wanted is None:
            return index
        repos = wanted.filter(F.col("section") == section).select("repo").distinct()
        return join_by_repo(index, repos, spread="path", how="left_semi")

    return listing.all_lines(
        of("files"), tables.routes(of("routes")), tables.db_tables(of("db")), tables.components(of("components"))
    )


def listing_costs(lines: DataFrame) -> DataFrame:
    """Costs of the listing sections, one row per section with both forms."""
    costs = listing.section_costs(lines)
    of_form = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c)))
    merged = costs.groupBy("repo", F.col("section").alias("name")).agg(
        of_form("full", "tokens").alias("full_tokens"),
        of_form("collapsed", "tokens").alias("collapsed_tokens"),
        of_form("full", "lines").alias("lines"),
    )
    count_text = F.when(
        F.col("name") == "components",
        F.concat(F.lit("### Components\n- "), F.col("lines").cast("string"), F.lit(" components")),
    )
    rank = F.create_map(*[F.lit(x) for kv in fx.SECTION_PRIORITIES.items() for x in kv])
    return merged.select(
        "repo", F.try_element_at(rank, F.col("name")).alias("priority"), "name", "full_tokens",
        F.coalesce(estimate_tokens(count_text), F.col("collapsed_tokens")).alias("collapsed_tokens"),
        F.lit(None).cast("string").alias("full_text"), count_text.alias("collapsed_text"),
    )


def bundles(
    index: DataFrame,
    settings: DataFrame,
    documents: DataFrame,
    tasks: DataFrame,
    budget: int | None = None,
    header: str = DEFAULT_HEADER,
) -> DataFrame:
    """``repo, text, tokens`` for every repository known to any input.

    Costs decide first. Listing lines are then made only of repositories that kept
    the section, and joined to the sections that were kept, so no text longer than
    the budget is ever collected.
    """
    texts = document_sections(documents, settings).unionByName(task_sections(tasks)).unionByName(
        map_sections(index, settings)
    )
    measured = b.measure(_with_budget(texts, settings, budget), F.col("budget"))
    listed = _with_budget(listing_costs(index_lines(index)), settings, budget)
    kept = b.choose_forms(measured.unionByName(listed)).select("repo", F.inline("kept"))
    # A few rows per repository, needed twice below.
    chosen = materialize(kept, "chosen-sections")

    wanted = chosen.filter(F.col("text").isNull()).select(
        "repo", F.col("name").alias("section"), "form", "priority"
    )
    keys = ["repo", "section", "form"]
    spread = F.struct("group", "k1", "k2", "k3", "pos")
    kept_lines = join_by_key(index_lines(index, wanted), wanted, keys, spread, how="inner")
    priority = F.create_map(*[F.lit(x) for kv in fx.SECTION_PRIORITIES.items() for x in kv])
    listed_texts = listing.section_texts(kept_lines).select(
        "repo", F.try_element_at(priority, F.col("section")).alias("priority"), "text"
    )
    pieces = (
        chosen.filter(F.col("text").isNotNull()).select("repo", "priority", "text")
        .unionByName(listed_texts)
    )
    ordered = F.array_sort(F.collect_list(F.struct("priority", "text")))
    body = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n")
    texts_by_repo = pieces.groupBy("repo").agg(body.alias("body"))
    return bundle_text(_known(index, settings, documents, tasks), texts_by_repo, header)


def _known(
    index: DataFrame, settings: DataFrame, documents: DataFrame, tasks: DataFrame
) -> DataFrame:
    def mark(rows: DataFrame, indexed: bool) -> DataFrame:
        return rows.select("repo", F.lit(indexed).alias("indexed"))

    rows = mark(settings, True).unionByName(mark(index, True))
    rows = rows.unionByName(mark(documents, False)).unionByName(mark(tasks, False))
    return rows.groupBy("repo").agg(F.max("indexed").alias("indexed"))


def bundle_text(known: DataFrame, texts: DataFrame, header: str = DEFAULT_HEADER) -> DataFrame:
    """Header and body, or a hint where there is no body; tokens include the header."""
    body = F.coalesce("body", F.lit(""))
    hint = F.when(F.col("indexed"), HINT_INDEXED).otherwise(HINT_NEW)
    shown = F.when(trim(body) == "", hint).otherwise(body)
    head = F.lit(header)
    return known.join(texts, "repo", "left").select(
        "repo",
        F.concat(head, F.lit("\n"), shown, F.lit("\n")).alias("text"),
        (estimate_tokens(body) + estimate_tokens(head)).alias("tokens"),
    )
