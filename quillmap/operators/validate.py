"""Checking snapshot documents before they are trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.plans.joins import number_rows
from quillmap.sources.documents import FILE_SCHEMA
from quillmap.sources.json_elements import JsonDocuments, read_json

MALFORMED = "index is not valid JSON"
_TOP_LEVEL = [
    ("generatedAt", "STRING", "a string"),
    ("root", "STRING", "a string"),
    ("stack", "ARRAY", "an array"),
    ("files", "ARRAY", "an array"),
    ("routes", "ARRAY", "an array"),
    ("components", "ARRAY", "an array"),
    ("db", "OBJECT", "an object"),
    ("stats", "OBJECT", "an object"),
]
_PER_FILE = [
    ("path", "STRING", "a string"),
    ("hash", "STRING", "a string"),
    ("exports", "ARRAY", "an array"),
    ("imports", "ARRAY", "an array"),
]


def _is(kinds: Column, name: str, kind: str) -> Column:
    return F.coalesce(F.element_at(kinds, name) == kind, F.lit(False))


def _version_problem(listed: Column) -> Column:
    """``listed`` is the text of a version that is an array."""
    text, kind = F.element_at("texts", "schemaVersion"), F.element_at("kinds", "schemaVersion")
    right = (kind == "NUMBER") & (text.try_cast("double") == fx.SNAPSHOT_VERSION)
    shown = (
        F.when(kind.isNull(), "undefined")
        .when(kind == "OBJECT", "[object Object]")
        .when(kind == "ARRAY", F.coalesce(listed, F.lit("")))
        .otherwise(text)
    )
    expected = F.lit(f"schemaVersion mismatch: expected {fx.SNAPSHOT_VERSION}, got ")
    return F.when(~F.coalesce(right, F.lit(False)), F.concat(expected, shown))


def _head_problems(listed: Column) -> Column:
    top = [_version_problem(listed)] + [
        F.when(~_is(F.col("kinds"), name, kind), F.lit(f"{name} must be {what}")) for name, kind, what in _TOP_LEVEL
    ]
    return (
        F.when(F.col("kind").isNull(), F.array(F.lit(MALFORMED)))
        .when(F.col("kind") == "OBJECT", F.array_compact(F.array(*top)))
        .otherwise(F.array(F.lit("index is not an object")))
    )


def _file_problems() -> Column:
    at = F.concat(F.lit("files["), F.col("at").cast("string"), F.lit("]"))
    checks = [
        F.when(~_is(F.col("kinds"), name, kind), F.concat(at, F.lit(f".{name} must be {text}")))
        for name, kind, text in _PER_FILE
    ]
    return F.when(F.col("kind") == "OBJECT", F.array_compact(F.array(*checks))).otherwise(
        F.array(F.concat(at, F.lit(" is not an object")))
    )


def _under(elements: DataFrame, *path: str) -> DataFrame:
    return elements.filter(F.col("path") == F.array(*map(F.lit, path)))


def _versions(elements: DataFrame) -> DataFrame:
    """Versions that are arrays, as text; they have few elements in any document that is meant as one."""
    scalar = F.when(F.col("kind") == "STRING", F.get_json_object(F.concat(F.lit("["), "element", F.lit("]")), "$[0]"))
    shown = F.when(F.col("kind") == "NULL", "").otherwise(F.coalesce(scalar, F.trim("element")))
    rows = _under(elements, "schemaVersion").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("text")))).alias("rows"))
    return rows.select("doc", F.array_join(F.transform("rows", lambda r: r["text"]), ",").alias("listed"))


def _problems(found: JsonDocuments) -> tuple[DataFrame, DataFrame]:
    """Problems of heads, as one array per document, and those of files, as one array per file that has any."""
    heads = found.heads.join(_versions(found.elements), "doc", "left")
    tops = heads.select("repo", "doc", _head_problems(F.col("listed")).alias("problems"))
    files = _under(found.elements, "files").select("repo", "doc", "at", _file_problems().alias("problems"))
    return tops, files.filter(F.size("problems") > 0)


def snapshot_problems(documents: DataFrame) -> DataFrame:
    """``repo, value`` to one row per problem, numbered from 0 in report order. Files are rows of their own
    throughout, so a document may have any number of them."""
    tops, files = _problems(read_json(documents))
    first = tops.select("repo", "doc", F.posexplode("problems").alias("pos", "problem"))
    rows = files.select("repo", "doc", "at", F.posexplode("problems").alias("nth", "problem"))
    numbered = number_rows(rows.withColumn("place", F.col("at") * (len(_PER_FILE) + 1) + F.col("nth")), ["doc"], "place", "n")
    after = numbered.join(tops.select("doc", F.size("problems").alias("before")), "doc")
    later = after.select("repo", (F.col("before") + F.col("n") - 1).cast("int").alias("pos"), "problem")
    return first.select("repo", "pos", "problem").unionByName(later)


def read_snapshots(documents: DataFrame) -> DataFrame:
    """Documents without problems as rows: ``repo, path, at, element``, one for each element of their lists, with the
    keys that lead to the list; all other documents count as absent."""
    found = read_json(documents)
    tops, files = _problems(found)
    bad = tops.filter(F.size("problems") > 0).select("doc").unionByName(files.select("doc")).distinct()
    return found.elements.join(bad, "doc", "left_anti").select("repo", "path", "at", "element")


def snapshot_files(snapshots: DataFrame) -> DataFrame:
    """File rows of read snapshots, in the shape of a file index."""
    file = F.from_json("element", FILE_SCHEMA, {"allowSingleQuotes": "false"})
    rows = _under(snapshots, "files").select("repo", file.alias("file")).select("repo", "file.*")
    return rows.select(
        "repo", "path", "lang", "hash", "purpose",
        F.coalesce("purposeStale", F.lit(False)).alias("purpose_stale"), "exports", "imports",
    )
