"""Indented JSON text from columns, two blanks per level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A JSON string, or ``null``."""
    text = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(text, 2, F.length(text) - 2))


def flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def list_text(items: Column, level: int) -> Column:
    """A list of already rendered items, closed at ``level``."""
    inner, outer = "\n" + "  " * (level + 1), "\n" + "  " * level
    body = F.concat(F.lit("[" + inner), F.array_join(items, "," + inner), F.lit(outer + "]"))
    return F.when(F.size(items) > 0, body).otherwise("[]")


def strings(items: Column, level: int) -> Column:
    return list_text(F.transform(items, quoted), level)


def object_text(fields: dict[str, Column], level: int) -> Column:
    """An object of already rendered fields; NULL fields are left out."""
    inner, outer = "\n" + "  " * (level + 1), "\n" + "  " * level
    pairs = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    joined = F.array_join(F.array_compact(F.array(*pairs)), "," + inner)
    return F.concat(F.lit("{" + inner), joined, F.lit(outer + "}"))
