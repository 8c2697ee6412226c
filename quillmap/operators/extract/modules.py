"""Imports and exported symbols of script modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.arrays import find_all, find_first, find_matches, first_per_name, matches
from quillmap.functions.text import js, trim
from quillmap.operators.extract.base import FileColumns, has_extension

_IS_NAME = f"^{fx.IDENTIFIER}" + r"\z"


def _symbol(name: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(name.alias("name"), kind.alias("kind"))


def _const_symbols(names: Column) -> Column:
    return F.transform(names, lambda n: _symbol(n, "const"))


def _names_only(parts: Column) -> Column:
    return F.filter(parts, lambda n: matches(n, _IS_NAME))


def import_specifiers(src: Column) -> Column:
    return F.concat(
        find_all(src, fx.IMPORT_FROM), find_all(src, fx.REQUIRE_CALL), find_all(src, fx.EXPORT_FROM)
    )


def normalize_imports(specifiers: Column, cap: int = fx.IMPORT_CAP) -> Column:
    runtime = F.array(*[F.lit(m) for m in fx.RUNTIME_MODULES])
    kept = F.filter(
        specifiers, lambda s: ~F.array_contains(runtime, F.regexp_replace(s, "^node:", ""))
    )
    return F.slice(F.array_distinct(kept), 1, cap)


def declared_exports(src: Column) -> Column:
    def build(word: Column, name: Column) -> Column:
        kind = (
            F.when(F.startswith(word, F.lit("function")), "function")
            .when(word.isin("let", "var"), "const")
            .otherwise(word)
        )
        return _symbol(name, kind)

    return find_matches(src, fx.EXPORT_DECLARATION, build, 1, 2)


def default_exports(src: Column) -> Column:
    names = find_all(src, fx.EXPORT_DEFAULT, 2)
    return F.transform(
        names, lambda n: _symbol(F.when(n == "", "default").otherwise(n), "default")
    )


def brace_exports(src: Column) -> Column:
    def exported_name(part: Column) -> Column:
        alias = find_first(part, fx.BRACE_ALIAS)
        plain = trim(F.regexp_replace(part, js(fx.BRACE_ALIAS_TAIL), ""))
        return F.when(alias != "", alias).otherwise(plain)

    inside = find_all(src, fx.EXPORT_BRACES)
    parts = F.flatten(F.transform(inside, lambda x: F.split(x, ",")))
    names = F.transform(parts, lambda p: exported_name(trim(p)))
    return _const_symbols(F.filter(_names_only(names), lambda n: n != "default"))


def commonjs_assignment(src: Column) -> Column:
    word = find_first(src, fx.COMMONJS_ASSIGN, 1)
    name = find_first(src, fx.COMMONJS_ASSIGN, 2)
    kind = (
        F.when(F.startswith(word, F.lit("function")), "function")
        .when(word == "class", "class")
        .otherwise("default")
    )
    return F.filter(F.array(_symbol(name, kind)), lambda s: s["name"] != "")


def commonjs_object_keys(src: Column) -> Column:
    parts = F.split(find_first(src, fx.COMMONJS_OBJECT), ",")
    keys = F.transform(parts, lambda p: trim(F.substring_index(trim(p), ":", 1)))
    return _const_symbols(_names_only(keys))


def commonjs_properties(src: Column) -> Column:
    return _const_symbols(find_all(src, fx.COMMONJS_PROPERTY))


def exported_symbols(src: Column) -> Column:
    """All export forms in order; the first kind seen for a name stays."""
    modules = F.concat(declared_exports(src), default_exports(src), brace_exports(src))
    commonjs = F.concat(
        commonjs_assignment(src), commonjs_object_keys(src), commonjs_properties(src)
    )
    none = F.array().cast("array<struct<name:string,kind:string>>")
    return first_per_name(
        F.concat(
            F.when(F.contains(src, F.lit("export")), modules).otherwise(none),
            F.when(F.contains(src, F.lit("exports")), commonjs).otherwise(none),
        )
    )


class ModuleExtractor:
    name = "js-ts"
    stacks: tuple[str, ...] = ()

    def applies(self, file: FileColumns) -> Column:
        return has_extension(file, fx.SCRIPT_EXTENSIONS)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {
            "imports": normalize_imports(import_specifiers(file.clean)),
            "exports": exported_symbols(file.clean),
        }
