"""What an extractor is, and the typed lists it may contribute to."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_TYPES = {
    "imports": "string",
    "exports": "struct<name:string,kind:string>",
    "routes": "struct<framework:string,method:string,url:string>",
    "components": "struct<name:string,props:array<string>,client:boolean,hooks:array<string>>",
    "tables": "struct<engine:string,name:string,columns:array<string>>",
}


class FileColumns(NamedTuple):
    """Columns of one file: ``clean`` is the text with comments stripped."""

    path: Column
    ext: Column
    raw: Column
    clean: Column


class Extractor(Protocol):
    """Extension point: pure column expressions over one file.

    ``stacks`` names the stacks of which a repository needs at least one; empty
    means the extractor needs none.
    """

    name: str
    stacks: tuple[str, ...]

    def applies(self, file: FileColumns) -> Column: ...

    def lists(self, file: FileColumns) -> dict[str, Column]: ...


def empty_list(kind: str) -> Column:
    return F.array().cast(f"array<{LIST_TYPES[kind]}>")


def has_extension(file: FileColumns, extensions: list[str]) -> Column:
    return file.ext.isin(extensions)
