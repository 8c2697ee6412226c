"""JSON documents as ordered rows.

The document of a large repository does not fit one row. It is kept as rows of
text in a total order instead; written out sorted, they are the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions import json_text as j
from quillmap.functions.text import icu
from quillmap.operators import tables
from quillmap.operators.board import board_lines
from quillmap.operators.snapshot import repo_stats

_KEYS = ["k1", "k2", "k3", "pos"]


def row_order() -> list[Column]:
    return [F.col("slot"), *[icu(F.col(k)) for k in ("k1", "k2", "k3")], F.col("pos")]


def _elements(rows: DataFrame, slot: int, text: Column, keys: list[str]) -> DataFrame:
    columns = [F.col(k) if k in keys else F.lit("") for k in keys]
    columns += [F.lit("")] * (3 - len(columns))
    pos = F.col("pos") if "pos" in rows.columns else F.lit(0)
    return rows.select(
        "repo", F.lit(slot).alias("slot"),
        *[c.alias(k) for k, c in zip(_KEYS[:3], columns, strict=True)],
        pos.alias("pos"), text.alias("text"),
    )


def _documents(
    heads: DataFrame, scalars: dict[int, Column], lists: dict[int, tuple[str, int, str]],
    elements: DataFrame, last_slot: int,
) -> DataFrame:
    """Put fixed lines and list elements together.

    ``lists`` maps the slot of a list's elements to its name, indent level and
    the text after its closing bracket. The last element of each list, found by
    a partial aggregate, is the one without a comma.
    """
    keys = F.struct(*_KEYS)
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(row_order())], *_KEYS[:3])
    lasts = (
        elements.groupBy("repo", "slot").agg(F.max_by(keys, order).alias("last"))
        .select("repo", "slot", "last.*", F.lit(True).alias("is_last"))
    )
    marked = elements.join(lasts, ["repo", "slot", *_KEYS], "left").withColumn(
        "text",
        F.concat(F.col("text"), F.when(F.col("is_last"), "").otherwise(",")),
    )
    filled = heads.join(
        lasts.groupBy("repo").agg(
            *[F.max(F.col("slot") == s).alias(f"has_{s}") for s in lists]
        ),
        "repo", "left",
    )
    fixed = {s: c for s, c in scalars.items()}
    for slot, (name, level, after) in lists.items():
        has = F.coalesce(F.col(f"has_{slot}"), F.lit(False))
        pad = "  " * level
        fixed[slot - 1] = F.when(has, f'{pad}"{name}": [').otherwise(f'{pad}"{name}": []{after}')
        fixed[slot + 1] = F.when(has, f"{pad}]{after}")
    fixed[0] = F.lit("{")
    fixed[last_slot] = F.lit("}")
    lines = F.array(
        *[F.struct(F.lit(s).alias("slot"), c.alias("text")) for s, c in sorted(fixed.items())]
    )
    scaffold = filled.select("repo", F.inline(lines)).filter(F.col("text").isNotNull())
    scaffold = scaffold.select(
        "repo", "slot", *[F.lit("").alias(k) for k in _KEYS[:3]], F.lit(0).alias("pos"), "text"
    )
    return scaffold.unionByName(marked.drop("is_last"))


def _padded(text: Column, level: int) -> Column:
    return F.concat(F.lit("  " * level), text)


def _route_elements(index: DataFrame, slot: int) -> DataFrame:
    fields = {k: j.quoted(F.col(k)) for k in ("framework", "method", "path", "file")}
    text = _padded(j.object_text(fields, 2), 2)
    return _elements(tables.routes(index), slot, text, ["path", "method", "file"])


def _component_elements(index: DataFrame, slot: int) -> DataFrame:
    fields = {
        "name": j.quoted(F.col("name")),
        "file": j.quoted(F.col("file")),
        "props": j.strings(F.col("props"), 3),
        "client": j.flag(F.col("client")),
        "hooks": F.when(F.col("hooks").isNotNull(), j.strings(F.col("hooks"), 3)),
    }
    text = _padded(j.object_text(fields, 2), 2)
    return _elements(tables.components(index), slot, text, ["name", "file"])


def _db_elements(index: DataFrame, slots: dict[str, int]) -> list[DataFrame]:
    rows = tables.db_tables(index)
    names = {"postgres": ("table", "columns"), "prisma": ("model", "fields"), "mongo": ("collection", "fields")}
    out = []
    for engine, slot in slots.items():
        title, columns = names[engine]
        fields = {title: j.quoted(F.col("name")), columns: j.strings(F.col("columns"), 4)}
        if engine == "postgres":
            fields["source"] = j.quoted(F.col("source"))
        text = _padded(j.object_text(fields, 3), 3)
        out.append(_elements(rows.filter(F.col("engine") == engine), slot, text, ["name", "source"]))
    return out


def _file_elements(index: DataFrame, slot: int) -> DataFrame:
    exports = F.transform(
        "exports",
        lambda e: j.object_text({"name": j.quoted(e["name"]), "kind": j.quoted(e["kind"])}, 4),
    )
    fields = {
        "path": j.quoted(F.col("path")),
        "hash": j.quoted(F.col("hash")),
        "lang": j.quoted(F.col("lang")),
        "purpose": j.quoted(F.col("purpose")),
        "purposeStale": j.flag(F.col("purpose_stale")),
        "exports": j.list_text(exports, 3),
        "imports": j.strings(F.col("imports"), 3),
    }
    text = _padded(j.object_text(fields, 2), 2)
    return _elements(index, slot, text, ["path"])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def snapshot_json_rows(index: DataFrame, settings: DataFrame, generated_at: str) -> DataFrame:
    """The snapshot of every repository as rows of an indented JSON document."""
    heads = settings.select("repo", "project_name", "stack").join(repo_stats(index), "repo", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    stats = j.object_text(
        {"files": count("files"), "indexedFiles": count("indexed_files"), "loc": count("loc")}, 1
    )
    scalars = {
        1: F.lit(f'  "schemaVersion": {fx.SNAPSHOT_VERSION},'),
        2: F.concat(F.lit('  "generatedAt": '), j.quoted(F.lit(generated_at)), F.lit(",")),
        3: F.concat(F.lit('  "root": '), j.quoted(F.col("project_name")), F.lit(",")),
        4: F.concat(F.lit('  "stack": '), j.strings(F.col("stack"), 1), F.lit(",")),
        5: F.concat(F.lit('  "stats": '), stats, F.lit(",")),
        30: F.lit('  "db": {'),
        60: F.lit("  }"),
    }
    lists = {
        11: ("files", 1, ","),
        15: ("routes", 1, ","),
        21: ("components", 1, ","),
        41: ("postgres", 2, ","),
        45: ("prisma", 2, ","),
        51: ("mongo", 2, ""),
    }
    elements = _union([
        _file_elements(index, 11),
        _route_elements(index, 15),
        _component_elements(index, 21),
        *_db_elements(index, {"postgres": 41, "prisma": 45, "mongo": 51}),
    ])
    return _documents(heads, scalars, lists, elements, 90)


def bundle_json_rows(
    index: DataFrame, settings: DataFrame, texts: DataFrame, tasks: DataFrame
) -> DataFrame:
    """The bundle without a budget as JSON; ``texts`` is ``repo, state, handoff, plan, decisions``."""
    heads = settings.select("repo", "stack").join(texts, "repo", "left")
    scalars = {
        i: F.concat(
            F.lit(f'  "{name}": '), j.quoted(F.coalesce(F.col(name), F.lit(""))), F.lit(",")
        )
        for i, name in enumerate(["state", "handoff", "plan", "decisions"], 1)
    }
    scalars[5] = F.concat(F.lit('  "stack": '), j.strings(F.col("stack"), 1), F.lit(","))
    scalars[30] = F.lit('  "db": {')
    scalars[60] = F.lit("  },")
    lists = {
        15: ("routes", 1, ","),
        21: ("components", 1, ","),
        41: ("postgres", 2, ","),
        45: ("prisma", 2, ","),
        51: ("mongo", 2, ""),
        71: ("tasks", 1, ""),
    }
    task_fields = {
        "id": j.quoted(F.col("id")),
        "title": j.quoted(F.col("title")),
        "suited": j.strings(F.col("suited"), 3),
        "status": j.quoted(F.col("status")),
        "claimedBy": j.quoted(F.col("claimed_by")),
        "notes": j.quoted(F.col("notes")),
        "deps": j.strings(F.col("deps"), 3),
    }
    elements = _union([
        _route_elements(index, 15),
        _component_elements(index, 21),
        *_db_elements(index, {"postgres": 41, "prisma": 45, "mongo": 51}),
        _elements(tasks, 71, _padded(j.object_text(task_fields, 2), 2), ["id"]),
    ])
    return _documents(heads, scalars, lists, elements, 90)


def task_json_rows(tasks: DataFrame) -> DataFrame:
    """Tasks of each repository sorted by id, one JSON object per row."""
    fields = F.struct(
        "id", "title", "suited", "status", F.col("claimed_by").alias("claimedBy"), "notes", "deps"
    )
    return tasks.select(
        "repo", "id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("text")
    )


def write_board(tasks: DataFrame, json_path: str, board_path: str) -> None:
    """Store the tasks sorted by id as JSON lines, and the board as text."""
    write_rows(task_json_rows(tasks), json_path, [icu(F.col("id"))])
    write_rows(board_lines(tasks), board_path, [F.col("rank"), icu(F.col("id"))])


def write_rows(rows: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """Write document rows below ``path/repo=<repo>/``; part files in name order are the document."""
    order = row_order() if order is None else order
    sort = [F.col("repo"), *order]
    (
        rows.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .select("repo", "text")
        .write.mode("overwrite")
        .partitionBy("repo")
        .text(path)
    )
