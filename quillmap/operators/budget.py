"""Fitting sections into a token budget, greedily by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import estimate_tokens, trim
from quillmap.plans.joins import first_per_key

_ENTRY = ["priority", "name", "full_tokens", "collapsed_tokens", "full_text", "collapsed_text"]


def measure(sections: DataFrame, budget: int | Column) -> DataFrame:
    """Costs of ``repo, priority, name, body, collapsed`` rows.

    Texts are trimmed before they are measured. A form that could never fit
    keeps its cost but not its text, so oversized texts are not shuffled.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    trimmed = sections.select(
        "repo", "priority", "name", budget.cast("bigint").alias("budget"),
        trim(F.col("body")).alias("full_text"), trim(F.col("collapsed")).alias("collapsed_text"),
    )
    full = estimate_tokens(F.col("full_text"))
    collapsed = F.nullif(estimate_tokens(F.col("collapsed_text")), F.lit(0))
    costed = trimmed.withColumn("full_tokens", full).withColumn("collapsed_tokens", collapsed)
    return costed.withColumn(
        "full_text", F.when(F.col("full_tokens") <= F.col("budget"), F.col("full_text"))
    ).withColumn(
        "collapsed_text",
        F.when(F.col("collapsed_tokens") <= F.col("budget"), F.col("collapsed_text")),
    )


def candidates(measured: DataFrame) -> DataFrame:
    """Drop sections that cannot be kept whatever else is, however many there are.

    What is left of the budget never grows. So once a section with least cost m
    has been refused, so are all later ones of that cost; and at most budget/m
    of them can be accepted. The first budget/m per cost are all that matter,
    which bounds a repository by the budget and not by its rows.
    """
    least = F.least("full_tokens", F.coalesce("collapsed_tokens", "full_tokens"))
    possible = (
        measured.filter(F.col("full_tokens") > 0)
        .withColumn("least", least)
        .filter(F.col("least") <= F.col("budget"))
    )
    limit = F.floor(F.col("budget") / F.col("least"))
    order = [F.col("priority"), F.col("name")]
    return first_per_key(
        possible, ["repo", "least"], order, limit, spread=F.struct("priority", "name")
    ).drop("rank", "least")


def choose_forms(measured: DataFrame) -> DataFrame:
    """One row per repository with its kept sections in order.

    ``kept`` holds structs of ``priority, name, form, tokens, text``. Each
    section takes its full form if that fits what is left, else its collapsed
    form if that fits, else it is skipped and the next one is tried. The fold
    runs over the bounded candidates only.
    """
    gathered = measured.filter(F.col("full_tokens") > 0).groupBy("repo").agg(
        F.max("budget").alias("budget"),
        F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("entries"),
    )

    def step(acc: Column, e: Column) -> Column:
        left = F.col("budget") - acc["used"]
        takes_full = e["full_tokens"] <= left
        takes_short = F.coalesce(e["collapsed_tokens"] <= left, F.lit(False))
        cost = (
            F.when(takes_full, e["full_tokens"])
            .when(takes_short, e["collapsed_tokens"])
            .otherwise(F.lit(0).cast("bigint"))
        )
        mark = F.when(takes_full, "f").when(takes_short, "c").otherwise("-")
        return F.struct(
            (acc["used"] + cost).alias("used"), F.concat(acc["marks"], mark).alias("marks")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit("").alias("marks"))
    marked = gathered.withColumn("marks", F.aggregate("entries", start, step)["marks"])

    forms = F.split(F.col("marks"), "")

    def keep(e: Column, mark: Column) -> Column:
        full = mark == "f"
        return F.when(
            mark.isin("f", "c"),
            F.struct(
                e["priority"].alias("priority"),
                e["name"].alias("name"),
                F.when(full, "full").otherwise("collapsed").alias("form"),
                F.when(full, e["full_tokens"]).otherwise(e["collapsed_tokens"]).alias("tokens"),
                F.when(full, e["full_text"]).otherwise(e["collapsed_text"]).alias("text"),
            ),
        )

    kept = F.array_compact(F.zip_with(F.col("entries"), forms, keep))
    return marked.select("repo", "budget", kept.alias("kept"))


def assemble(sections: DataFrame, budget: int | Column) -> DataFrame:
    """Bundles ``repo, text, tokens, kept, collapsed`` of any sections table."""
    chosen = choose_forms(candidates(measure(sections, budget)))
    repos = sections.select("repo").distinct()
    text = F.coalesce(F.array_join(F.transform("kept", lambda k: k["text"]), "\n\n"), F.lit(""))

    def names(form: str) -> Column:
        of_form = F.filter("kept", lambda k: k["form"] == form)
        none = F.array().cast("array<string>")
        return F.coalesce(F.transform(of_form, lambda k: k["name"]), none)

    joined = repos.join(chosen, "repo", "left")
    return joined.select(
        "repo",
        text.alias("text"),
        estimate_tokens(text).alias("tokens"),
        names("full").alias("kept"),
        names("collapsed").alias("collapsed"),
    )


def section_forms(sections: DataFrame, budget: int | Column) -> DataFrame:
    """Every section with its form: full, collapsed, dropped or empty."""
    measured = measure(sections, budget).drop("full_text", "collapsed_text")
    narrow = measured.withColumn("full_text", F.lit(None).cast("string")).withColumn(
        "collapsed_text", F.lit(None).cast("string")
    )
    kept = choose_forms(candidates(narrow)).select("repo", F.inline("kept")).drop("tokens", "text")
    form = F.when(F.col("full_tokens") == 0, "empty").otherwise(
        F.coalesce("form", F.lit("dropped"))
    )
    return (
        measured.join(kept, ["repo", "priority", "name"], "left")
        .select("repo", "priority", "name", form.alias("form"))
    )
