"""User-interface components with their props and hooks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.arrays import find_all, find_first, find_matches, first_per_name, let, matches
from quillmap.functions.text import is_client, trim
from quillmap.operators.extract.base import FileColumns, empty_list, has_extension


def prop_names(parameter: Column) -> Column:
    def name(part: Column) -> Column:
        left = F.substring_index(F.substring_index(trim(part), ":", 1), "=", 1)
        return trim(F.regexp_replace(left, r"^([\s\S]*?)\.\.\.", "$1"))

    parts = F.split(find_first(trim(parameter), fx.LEADING_BRACES), ",")
    return F.filter(
        F.transform(parts, name), lambda p: matches(p, f"^{fx.IDENTIFIER}" + r"\z")
    )


def hook_names(clean: Column) -> Column:
    found = F.array_sort(F.array_distinct(find_all(clean, fx.HOOK_CALL)))
    return F.when(F.contains(clean, F.lit("use")), found).otherwise(F.array().cast("array<string>"))


def has_markup(clean: Column) -> Column:
    return matches(clean, fx.MARKUP_TAG) | matches(clean, fx.MARKUP_RETURN)


def component_names(clean: Column) -> Column:
    """Function declarations first, then arrow constants, first of a name stays."""

    def build(name: Column, parameter: Column) -> Column:
        return F.struct(name.alias("name"), prop_names(parameter).alias("props"))

    return first_per_name(
        F.concat(
            find_matches(clean, fx.FUNCTION_COMPONENT, build, 1, 2),
            find_matches(clean, fx.ARROW_COMPONENT, build, 1, 2),
        )
    )


def components(raw: Column, clean: Column) -> Column:
    whole_file = F.struct(is_client(raw).alias("client"), hook_names(clean).alias("hooks"))

    def described(file: Column) -> Column:
        return F.transform(
            component_names(clean),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["props"].alias("props"),
                file["client"].alias("client"),
                F.when(F.size(file["hooks"]) > 0, file["hooks"]).alias("hooks"),
            ),
        )

    found = let(whole_file, described)
    return F.when(has_markup(clean), found).otherwise(empty_list("components"))


class ComponentExtractor:
    name = "react"
    stacks = ("react", "nextjs")

    def applies(self, file: FileColumns) -> Column:
        return has_extension(file, fx.MARKUP_EXTENSIONS)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"components": components(file.raw, file.clean)}
