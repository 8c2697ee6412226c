"""Small array helpers used by the extractors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.text import js


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` likes."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(js(pattern)), F.lit(group))


def find_first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, js(pattern), group)


def find_matches(text: Column, pattern: str, build: Callable[..., Column], *groups: int) -> Column:
    """One scan of the text for whole matches, then the groups of each match."""
    whole = find_all(text, pattern, 0)
    return F.transform(whole, lambda m: build(*[find_first(m, pattern, g) for g in groups]))


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(js(pattern)))


def first_per_name(items: Column) -> Column:
    """Keep the first struct of each ``name``; arrays without repeats pass as they are."""

    def distinct(all_items: Column, names: Column) -> Column:
        firsts = F.filter(all_items, lambda x, i: F.array_position(names, x["name"]) == i + 1)
        repeats = F.size(F.array_distinct(names)) < F.size(all_items)
        return F.when(repeats, firsts).otherwise(all_items)

    return let(
        items,
        lambda all_items: let(
            F.transform(all_items, lambda x: x["name"]), lambda names: distinct(all_items, names)
        ),
    )


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")
