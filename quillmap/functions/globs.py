"""Ignore globs as regular expressions, computed per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.text import trim

#: Groups in parentheses are the only form of globs that is not translated.
UNSUPPORTED = r"(?<!\\)[()]"

_RANGE = r"\{-?\d{1,6}\.\.-?\d{1,6}\}|\{[A-Za-z]\.\.[A-Za-z]\}"
_CLASS = r"\[[!^]?\]?(?:\\.|[^\]\\])*\]"
#: What a glob consists of; the last form takes any character by itself.
_TOKEN = rf"\\[\s\S]|\*\*/|\*+|\?|{_CLASS}|{_RANGE}|[\s\S]"


def gitignore_globs(content: Column) -> Column:
    """Globs meant by the lines of an ignore file, blanks and comments dropped."""
    lines = F.filter(
        F.transform(F.split(content, "\n"), trim),
        lambda x: ~F.rlike(x, F.lit(r"^(?:[#!]|\z)")),
    )

    def to_glob(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(line, "^/", ""), r"/\z", "")
        anywhere = F.concat(F.lit("**/"), bare)
        return F.when(bare == "", None).when(F.startswith(line, F.lit("/")), bare).otherwise(anywhere)

    return F.filter(F.transform(lines, to_glob), lambda g: g.isNotNull())


def is_supported(glob: Column) -> Column:
    return ~F.rlike(glob, F.lit(UNSUPPORTED))


def literal_directory(glob: Column) -> Column:
    """The directories that a glob begins with as they are; ``''`` if there are none."""
    return F.regexp_replace(F.regexp_extract(glob, r"^(?:[^/*?\[\]{}()\\]+/)*", 0), r"/\z", "")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.+^$|(){}\[\]\\*?&~#-])", r"\\$1")


def _class_regex(token: Column) -> Column:
    """A bracket class; it never matches a slash. A range from a later to an earlier character holds nothing."""
    negated = F.rlike(token, F.lit(r"^\[[!^]"))
    body = F.regexp_extract(token, r"^\[[!^]?([\s\S]*)\]\z", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?:\\[\s\S]|[\s\S])-(?:\\[\s\S]|[^\\])|\\[\s\S]|[\s\S]"), F.lit(0))

    def member(part: Column) -> Column:
        bare = F.regexp_replace(part, r"\\([\s\S])", "$1")
        first, last = F.substring(bare, 1, 1), F.substring(bare, 3, 1)
        ranged = F.when(first <= last, F.concat(_escaped(first), F.lit("-"), _escaped(last))).otherwise("")
        return F.when(F.length(bare) == 3, ranged).otherwise(_escaped(bare))

    members = F.array_join(F.transform(parts, member), "")
    none = F.when(negated, "[^/]").otherwise("(?!)")
    held = F.concat(F.when(negated, F.lit("(?!/)[^")).otherwise("(?!/)["), members, F.lit("]"))
    return F.when(members == "", none).otherwise(held)


def _range_regex(token: Column) -> Column:
    ends = F.regexp_extract_all(token, F.lit(r"-?\d+|[A-Za-z]"), F.lit(0))
    first, last = ends[0], ends[1]
    numbers = F.transform(F.sequence(first.try_cast("int"), last.try_cast("int")), lambda n: n.cast("string"))
    letters = F.concat(F.lit("["), F.least(first, last), F.lit("-"), F.greatest(first, last), F.lit("]"))
    return F.when(first.try_cast("int").isNotNull(), F.concat(F.lit("(?:"), F.array_join(numbers, "|"), F.lit(")"))).otherwise(letters)


def _token_regex(token: Column) -> Column:
    """Every token but braces and commas."""
    return (
        F.when(token == "**/", "(?:.*/)?")
        .when(F.startswith(token, F.lit("**")), ".*")
        .when(token == "*", "[^/]*")
        .when(token == "?", "[^/]")
        .when(F.rlike(token, F.lit(rf"^(?:{_CLASS})\z")), _class_regex(token))
        .when(F.rlike(token, F.lit(rf"^(?:{_RANGE})\z")), _range_regex(token))
        .when(F.startswith(token, F.lit("\\")) & (F.length(token) == 2), _escaped(F.substring(token, 2, 1)))
        .otherwise(_escaped(token))
    )


def glob_regex(glob: Column) -> Column:
    """A glob as a regular expression: ``*``, ``**``, ``?``, classes, braces in braces, ranges in braces, escapes.

    A fold over the tokens carries for each open brace where its alternatives begin. A brace without a comma
    stands for itself, and so do braces that do not match.
    """
    tokens = F.regexp_extract_all(glob, F.lit(_TOKEN), F.lit(0))
    zero = F.struct(
        F.array(F.lit("")).alias("parts"), F.array().cast("array<boolean>").alias("commas"), F.lit(True).alias("matched")
    )

    def step(state: Column, token: Column) -> Column:
        parts, commas = state["parts"], state["commas"]
        depth = F.size(commas)
        outer, inner = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)

        def added(text: Column) -> Column:
            return F.concat(outer, F.array(F.concat(inner, text)))

        def closed() -> Column:
            before = F.element_at(outer, -1)
            group = F.when(F.element_at(commas, -1), F.concat(F.lit("(?:"), inner, F.lit(")"))).otherwise(
                F.concat(F.lit(r"\{"), inner, F.lit(r"\}")))
            return F.concat(F.slice(outer, 1, F.size(outer) - 1), F.array(F.concat(before, group)))

        def to(parts: Column, commas: Column, matched: Column = state["matched"]) -> Column:
            return F.struct(parts.alias("parts"), commas.alias("commas"), matched.alias("matched"))

        marked = F.concat(F.slice(commas, 1, depth - 1), F.array(F.lit(True)))
        return (
            F.when(token == "{", to(F.concat(parts, F.array(F.lit(""))), F.concat(commas, F.array(F.lit(False)))))
            .when((token == "}") & (depth > 0), to(closed(), F.slice(commas, 1, depth - 1)))
            .when(token == "}", to(added(F.lit(r"\}")), commas, F.lit(False)))
            .when((token == ",") & (depth > 0), to(added(F.lit("|")), marked))
            .otherwise(to(added(_token_regex(token)), commas))
        )

    plain = F.array_join(F.transform(tokens, _token_regex), "")
    folded = F.aggregate(
        tokens, zero, step,
        lambda s: F.when(s["matched"] & (F.size(s["commas"]) == 0), F.element_at(s["parts"], 1)),
    )
    return F.when(F.contains(glob, F.lit("{")), F.coalesce(folded, plain)).otherwise(plain)


def any_regex(patterns: Column) -> Column:
    """One pattern for a list of translated globs. A glob matches a path, or any directory above it."""
    return F.concat(F.lit("^(?:"), F.array_join(patterns, "|"), F.lit(r")(?:/[\s\S]*)?\z"))
