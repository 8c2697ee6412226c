"""Database tables, models and collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.arrays import find_all, find_first, find_matches, let, matches
from quillmap.functions.brackets import spans, split_top_level
from quillmap.functions.text import trim
from quillmap.operators.extract.base import FileColumns, empty_list, has_extension


def _table(engine: str, name: Column, columns: Column) -> Column:
    return F.struct(
        F.lit(engine).alias("engine"), name.alias("name"), columns.alias("columns")
    )


def _leading(parts: Column, pattern: str) -> Column:
    names = F.transform(parts, lambda p: find_first(trim(p), pattern))
    return F.filter(names, lambda n: n != "")


def models(raw: Column) -> Column:
    def build(name: Column, body: Column) -> Column:
        return _table("prisma", name, _leading(F.split(body, "\n"), fx.MODEL_FIELD))

    return find_matches(raw, fx.MODEL_BLOCK, build, 1, 2)


def ddl_bodies(raw: Column) -> Column:
    return spans(raw, fx.CREATE_TABLE, 1, "(", ")")


def ddl_columns(body: Column) -> Column:
    parts = F.filter(
        F.transform(split_top_level(body, "(", ")"), trim),
        lambda p: ~matches(p, fx.TABLE_CONSTRAINT),
    )
    return _leading(parts, fx.COLUMN_NAME)


def ddl_tables(raw: Column) -> Column:
    def build(full_name: Column, body: Column) -> Column:
        last = F.substring_index(full_name, ".", -1)
        return _table("postgres", F.when(last == "", full_name).otherwise(last), ddl_columns(body))

    found = F.zip_with(find_all(raw, fx.CREATE_TABLE), ddl_bodies(raw), build)
    worth_it = F.rlike(raw, F.lit("(?i)create"))
    return F.when(worth_it, found).otherwise(empty_list("tables"))


def typed_tables(raw: Column) -> Column:
    def build(name: Column, body: Column) -> Column:
        return _table("postgres", name, find_all(body, fx.TYPES_COLUMN))

    found = find_matches(raw, fx.TYPES_TABLE, build, 1, 2)
    return F.when(matches(raw, fx.TYPES_BLOCK), found).otherwise(empty_list("tables"))


_OPENING, _CLOSING = r"({\[", r")}\]"


def collection_name(clean: Column) -> Column:
    by_model = find_first(clean, fx.MODEL_CALL)
    by_variable = find_first(clean, fx.SCHEMA_VARIABLE)
    return (
        F.when(by_model != "", by_model)
        .when(by_variable != "", by_variable)
        .otherwise(fx.DEFAULT_COLLECTION)
    )


def collection_fields(body: Column) -> Column:
    return _leading(split_top_level(body, _OPENING, _CLOSING), fx.SCHEMA_FIELD)


def collections(clean: Column) -> Column:
    found = let(
        collection_name(clean),
        lambda name: F.transform(
            spans(clean, fx.NEW_SCHEMA, 0, "{", "}"),
            lambda body: _table("mongo", name, collection_fields(body)),
        ),
    )
    return F.when(F.contains(clean, F.lit("Schema")), found).otherwise(empty_list("tables"))


class ModelExtractor:
    name = "prisma"
    stacks: tuple[str, ...] = ()

    def applies(self, file: FileColumns) -> Column:
        return file.ext == "prisma"

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"tables": models(file.raw)}


class DdlExtractor:
    name = "sql"
    stacks: tuple[str, ...] = ()

    def applies(self, file: FileColumns) -> Column:
        return file.ext == "sql"

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"tables": ddl_tables(file.raw)}


class TypedTableExtractor:
    name = "supabase"
    stacks = ("supabase",)

    def applies(self, file: FileColumns) -> Column:
        return matches(file.path, fx.TYPES_PATH)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"tables": typed_tables(file.raw)}


class CollectionExtractor:
    name = "mongoose"
    stacks = ("mongoose",)

    def applies(self, file: FileColumns) -> Column:
        return has_extension(file, fx.SCRIPT_EXTENSIONS)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"tables": collections(file.clean)}
