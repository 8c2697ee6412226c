"""Project documents: Markdown with front matter, and the JSON files of a project.

JSON is read strictly: single quotes or text after the value make it malformed,
and malformed documents count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import is_blank, trim
from quillmap.sources.json_elements import is_json, read_json

FILE_SCHEMA = (
    "struct<path:string,hash:string,lang:string,purpose:string,purposeStale:boolean,"
    "exports:array<struct<name:string,kind:string>>,imports:array<string>>"
)
CONFIG_SCHEMA = (
    "struct<contextBudget:bigint,ignore:array<string>,extractors:map<string,boolean>,"
    "decisionsInContext:bigint,agentName:string>"
)
TASK_SCHEMA = (
    "struct<id:string,title:string,suited:array<string>,status:string,claimedBy:string,"
    "notes:string,deps:array<string>>"
)
_FRONT = r"\A---[ \t]*\r?\n(?:([\s\S]*?)\r?\n)??---[ \t]*(?:\r?\n|\z)"


def parse_json(text: Column, schema: str) -> Column:
    parsed = F.from_json(text, schema, {"allowSingleQuotes": "false"})
    return F.when(is_json(text), parsed)


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` lines of the leading block; empty map without a block."""
    block = F.regexp_extract(text, _FRONT, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            trim(F.substring_index(x, ":", 1)).alias("key"),
            trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"),
        ),
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]),
    )
    return F.map_from_entries(last)


def document_body(text: Column) -> Column:
    return F.regexp_replace(text, _FRONT, "")


def read_markdown(documents: DataFrame) -> DataFrame:
    """``repo, doc, text`` to ``repo, doc, front, body``."""
    return documents.select(
        "repo",
        "doc",
        front_matter(F.col("text")).alias("front"),
        document_body(F.col("text")).alias("body"),
    )


def write_markdown_text(front: Column, body: Column) -> Column:
    """Front matter in key order, then the body without leading line breaks."""
    lines = F.transform(
        F.array_sort(F.map_entries(front)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    block = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))
    text = F.concat(
        F.when(F.size(front) > 0, block).otherwise(""), F.regexp_replace(body, r"\A\n+", "")
    )
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def read_config(configs: DataFrame) -> DataFrame:
    """``repo, text`` to one row of settings per repository, defaults filled in."""
    parsed = configs.select("repo", parse_json(F.col("text"), CONFIG_SCHEMA).alias("c"))
    return parsed.select("repo", *_settings(F.col("c")))


def _settings(c: Column) -> list[Column]:
    return [
        F.coalesce(c["contextBudget"], F.lit(fx.DEFAULT_BUDGET)).cast("bigint").alias("context_budget"),
        F.coalesce(c["ignore"], F.array().cast("array<string>")).alias("ignore"),
        F.coalesce(c["extractors"], F.create_map().cast("map<string,boolean>")).alias("extractors"),
        F.coalesce(c["decisionsInContext"], F.lit(fx.DEFAULT_DECISIONS))
        .cast("bigint")
        .alias("decisions_in_context"),
        c["agentName"].alias("agent_name"),
    ]


def config_or_default(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """Settings of every repository, also of those without a config document."""
    parsed = configs.select("repo", parse_json(F.col("text"), CONFIG_SCHEMA).alias("c"))
    return repos.select("repo").join(parsed, "repo", "left").select("repo", *_settings(F.col("c")))


def read_tasks(documents: DataFrame) -> DataFrame:
    """``repo, text`` to one row per task. Anything but an array gives no rows, nor do its elements
    that are no objects; each element is parsed by itself."""
    found = read_json(documents, "text").elements.filter((F.size("path") == 0) & (F.col("kind") == "OBJECT"))
    task = F.from_json("element", TASK_SCHEMA, {"allowSingleQuotes": "false"})
    return found.select("repo", task.alias("task")).select("repo", "task.*").select(
        "repo",
        F.col("id"),
        F.col("title"),
        F.coalesce(F.col("suited"), F.array().cast("array<string>")).alias("suited"),
        F.col("status"),
        F.col("claimedBy").alias("claimed_by"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        F.coalesce(F.col("deps"), F.array().cast("array<string>")).alias("deps"),
    )


def read_dependencies(manifests: DataFrame) -> DataFrame:
    """``repo, content`` of package manifests to ``repo, name, dependencies``."""
    schema = (
        "struct<name:string,dependencies:map<string,string>,devDependencies:map<string,string>>"
    )
    parsed = manifests.select("repo", parse_json(F.col("content"), schema).alias("m"))
    none = F.array().cast("array<string>")
    names = F.array_union(
        F.coalesce(F.map_keys(F.col("m.dependencies")), none),
        F.coalesce(F.map_keys(F.col("m.devDependencies")), none),
    )
    return parsed.select("repo", F.col("m.name").alias("name"), names.alias("dependencies"))


def first_filled_lines(body: Column, n: int) -> Column:
    filled = F.filter(F.split(body, "\n"), lambda x: ~is_blank(x))
    return F.array_join(F.slice(filled, 1, n), "\n")
