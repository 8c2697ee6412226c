"""Listing lines of a repository and what a section made of them would cost.

A section can be far larger than any budget, so its text is never put together
to find that out: its length is a sum over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import base_name, directory, icu, rtrim, tokens_of_length, utf16_length
from quillmap.plans.joins import small_side
from quillmap.plans.storage import materialize

HEADS = {
    ("routes", "full"): "### Routes",
    ("db", "full"): "### Data model",
    ("components", "full"): "### Components",
    ("files", "full"): "### Files",
    ("files", "collapsed"): "### Files (summary)",
}
_KEYS = ["repo", "section", "form"]
_ORDER = ["group", "k1", "k2", "k3", "pos"]


def _lines(
    rows: DataFrame,
    section: str,
    form: str,
    line: Column,
    keys: list[str | Column],
    group: Column | None = None,
    pos: str | None = None,
) -> DataFrame:
    keys = [*keys, *[F.lit("")] * (3 - len(keys))]
    return rows.select(
        "repo",
        F.lit(section).alias("section"),
        F.lit(form).alias("form"),
        (F.lit("") if group is None else group).alias("group"),
        *[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys, 1)],
        (F.col(pos) if pos else F.lit(0)).alias("pos"),
        line.alias("line"),
    )


def line_order() -> Column:
    """Directory groups go by bytes, everything inside them by locale."""
    return F.struct(
        "group", *[icu(F.col(k)).alias(k) for k in ("k1", "k2", "k3")], "pos", F.col("line")
    )


def route_lines(routes: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("- "), F.col("method"), F.lit(" "), F.col("path"), F.lit("  →  "), F.col("file")
    )
    return _lines(routes, "routes", "full", line, ["path", "method", "file"], pos="pos")


def db_lines(tables: DataFrame) -> DataFrame:
    mark = F.when(F.col("engine") == "postgres", "").otherwise(
        F.concat(F.lit(" ("), F.col("engine"), F.lit(")"))
    )
    line = F.concat(
        F.lit("- "), F.col("name"), mark, F.lit(": "), F.array_join("columns", ", ")
    )
    rank = F.array_position(F.array(*[F.lit(e) for e in fx.ENGINE_ORDER]), F.col("engine"))
    return _lines(
        tables, "db", "full", line, ["name", "source"], group=rank.cast("string"), pos="pos"
    )


def component_lines(components: DataFrame) -> DataFrame:
    props = F.when(
        F.size("props") > 0, F.concat(F.lit(" ("), F.array_join("props", ", "), F.lit(")"))
    ).otherwise("")
    side = F.when(F.col("client"), "client").otherwise("server")
    line = F.concat(
        F.lit("- "), F.col("name"), props, F.lit(" ["), side, F.lit("]  "), F.col("file")
    )
    return _lines(components, "components", "full", line, ["name", "file"], pos="pos")


def file_description() -> Column:
    names = F.transform(F.slice("exports", 1, fx.LISTED_EXPORTS), lambda e: e["name"])
    listed = F.array_join(names, ", ")
    return (
        F.when(F.coalesce("purpose", F.lit("")) != "", F.concat(F.lit(" — "), F.col("purpose")))
        .when(listed != "", F.concat(F.lit(" — "), listed))
        .otherwise("")
    )


def directory_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("repo", directory(F.col("path")).alias("dir")).agg(
        F.count("*").alias("files")
    )


def file_lines(index: DataFrame) -> DataFrame:
    """Directory headings and the files below each, in full and as counts."""
    d = directory(F.col("path"))
    line = F.concat(F.lit("  "), base_name(F.col("path")), file_description())
    files = _lines(index, "files", "full", line, ["path"], group=d)
    counts = directory_counts(index)
    heading = F.concat(F.col("dir"), F.lit("/"))
    plural = F.when(F.col("files") == 1, "").otherwise("s")
    summary = F.concat(
        F.lit("- "), heading, F.lit(" — "), F.col("files").cast("string"), F.lit(" file"), plural
    )
    # Both forms of a directory come from one count.
    none = F.lit("")
    forms = F.array(*[
        F.struct(F.lit(f).alias("form"), g.alias("group"), k.alias("k1"), x.alias("line"))
        for f, g, k, x in [("full", F.col("dir"), none, heading), ("collapsed", none, F.col("dir"), summary)]
    ])
    directories = counts.select("repo", F.inline(forms)).select(
        "*", F.lit("files").alias("section"), none.alias("k2"), none.alias("k3"), F.lit(0).alias("pos")
    )
    return files.unionByName(directories)


def all_lines(
    index: DataFrame, routes: DataFrame, tables: DataFrame, components: DataFrame
) -> DataFrame:
    return (
        route_lines(routes)
        .unionByName(db_lines(tables))
        .unionByName(component_lines(components))
        .unionByName(file_lines(index))
    )


def _head() -> Column:
    pairs = [F.lit(x) for k, v in HEADS.items() for x in ("/".join(k), v)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("/", "section", "form"))


def section_costs(lines: DataFrame) -> DataFrame:
    """``repo, section, form, lines, tokens`` of each section, text not built.

    The only part of a section that trimming can reach is the end of its last
    line, since every line starts with something visible. So lines are brought
    into order only for sections that hold a line with a blank end, or a NULL.
    The sums, a few rows per repository, are stored to find these.
    """
    length = utf16_length(F.col("line"))
    blank_end = length - utf16_length(rtrim(F.col("line")))
    summed = lines.groupBy(*_KEYS).agg(
        F.sum(length + 1).alias("chars"),
        F.count("*").alias("lines"),
        (~F.coalesce(F.max(blank_end) == 0, F.lit(False)) | (F.count("line") < F.count("*"))).alias("ends_count"),
    )
    summed = materialize(summed, "section-sums")
    sections = summed.filter("ends_count").select(*[F.col(k).alias(f"of_{k}") for k in _KEYS])
    blank = F.lit(0)
    # A few kinds of sections, named so that no line of any other is made again.
    kinds = [r.of_section for r in sections.select("of_section").distinct().collect()]
    if kinds:
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in _KEYS]
        again = lines.filter(F.col("section").isin(kinds)).join(small_side(sections), same, "left_semi")
        last = again.groupBy(*_KEYS).agg(F.max_by(blank_end, line_order()).alias("blank_end"))
        last = last.select(*[F.col(k).alias(f"of_{k}") for k in _KEYS], "blank_end")
        summed = summed.join(last, same, "left")
        blank = F.when(F.col("ends_count"), F.col("blank_end")).otherwise(0)
    total = utf16_length(_head()) + F.col("chars") - blank
    return summed.select(*_KEYS, "lines", tokens_of_length(total).alias("tokens"))


def section_texts(lines: DataFrame) -> DataFrame:
    """Section texts. Only for sections already known to fit a budget."""
    ordered = F.array_sort(F.collect_list(line_order()))
    text = F.concat(
        _head(), F.lit("\n"), F.array_join(F.transform("ordered", lambda x: x["line"]), "\n")
    )
    return (
        lines.groupBy(*_KEYS)
        .agg(ordered.alias("ordered"))
        .select(*_KEYS, rtrim(text).alias("text"))
    )
