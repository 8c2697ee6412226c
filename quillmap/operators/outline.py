"""Outlines and excerpts of project documents, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.arrays import let, matches
from quillmap.functions.text import is_blank, js, trim, utf16_left


def plan_outline(text: Column) -> Column:
    """Each heading and the next filled line, unless that is a heading too.

    A heading is never blank, so among the filled lines its next line is simply
    its neighbour; pairing the list with itself shifted by one keeps this linear.
    """
    filled = F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))

    def entry(line: Column, after: Column) -> Column:
        indented = F.concat(F.lit("\n  "), utf16_left(trim(after), fx.OUTLINE_CHARS))
        plain = after.isNotNull() & ~matches(after, fx.HEADING)
        return F.when(
            matches(line, fx.HEADING), F.concat(line, F.when(plain, indented).otherwise(""))
        )

    def paired(lines: Column) -> Column:
        following = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
        return F.array_join(F.zip_with(lines, following, entry), "\n")

    return let(filled, paired)


def recent_blocks(text: Column, n: int | Column) -> Column:
    """First ``n`` blocks of a decision log that start with ``##``."""
    blocks = F.filter(
        F.split(text, js(fx.DECISION_BREAK)), lambda b: F.startswith(trim(b), F.lit("##"))
    )
    return trim(F.array_join(F.slice(blocks, F.lit(1), F.lit(n) if isinstance(n, int) else n), "\n\n"))
