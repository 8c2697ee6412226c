"""The catalog of checked queries: a Spark plan and, where possible, SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmap.checks.derived import DERIVED

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, using: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``using`` names derived inputs the SQL refers to."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle, *using)
        return fn

    return register


def with_inputs(sql: str, *using: str) -> str:
    if not using:
        return sql
    inputs = ",\n".join(f"{name} AS ({DERIVED[name]})" for name in using)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"WITH RECURSIVE {inputs},\n{body[len(start):]}"
    return f"WITH {inputs}\n{body}"


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)
