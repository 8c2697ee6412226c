"""Balanced spans and top-level splits without a per-character loop.

A possessive pattern handles nesting up to ``DEPTH`` in one linear scan. Only
rows beyond that (deeper nesting, brackets that do not pair up) take a fold
over their tokens, which is exact for any input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.arrays import let
from quillmap.functions.text import js

DEPTH = 8
_SPLIT_MARK = "\uffff"
_GROUP_MARK = "\x01"


def _inside(opening: str, closing: str, depth: int) -> str:
    plain = f"[^{opening}{closing}]*+"
    body = plain
    for _ in range(depth):
        body = f"{plain}(?:[{opening}]{body}[{closing}]{plain})*+"
    return body


def spans(text: Column, opener: str, groups: int, opening: str, closing: str) -> Column:
    """Text between each ``opener`` match (which ends in a bracket) and its partner.

    ``groups`` is how many capture groups ``opener`` has. An opener without a
    partner gives ``''``. Matches are those of ``opener`` alone, so one inside
    the span of another is still found.
    """
    body = _inside(opening, closing, DEPTH)
    pattern = F.lit(rf"{js(opener)}(?:(?=({body})[{closing}])|(?=([\s\S]*)))")
    quick = F.regexp_extract_all(text, pattern, F.lit(groups + 1))
    rest = F.regexp_extract_all(text, pattern, F.lit(groups + 2))
    # ``rest`` is filled only where the quick form found no partner.
    return F.zip_with(
        quick, rest, lambda q, r: F.when(r == "", q).otherwise(_walk(r, opening, closing))
    )


def _walk(rest: Column, opening: str, closing: str) -> Column:
    pieces = F.regexp_extract_all(rest, F.lit(f"[^{opening}{closing}]+|[{opening}{closing}]"), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        depth = (
            acc["depth"]
            + F.when(F.rlike(piece, F.lit(f"^[{opening}]")), 1).otherwise(0)
            - F.when(F.rlike(piece, F.lit(f"^[{closing}]")), 1).otherwise(0)
        )
        moved = F.struct(
            depth.alias("depth"),
            (acc["pos"] + F.length(piece)).alias("pos"),
            F.when(depth == 0, acc["pos"]).otherwise(F.lit(-1)).alias("stop"),
        )
        return F.when(acc["stop"] >= 0, acc).otherwise(moved)

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("pos"), F.lit(-1).alias("stop"))
    stop = F.aggregate(pieces, start, step)["stop"]
    return F.when(stop >= 0, F.left(rest, stop)).otherwise(F.lit(""))


def split_top_level(body: Column, opening: str, closing: str) -> Column:
    """Parts of ``body`` between commas at bracket depth 0.

    In the quick form, bracket groups inside a part are replaced by one mark
    character; callers look only at what a part starts with.
    """
    group = f"[{opening}]{_inside(opening, closing, DEPTH)}[{closing}]"
    masked = F.regexp_replace(F.regexp_replace(body, group, _GROUP_MARK), group, _GROUP_MARK)

    def marked(quick: Column) -> Column:
        unpaired = F.rlike(quick, F.lit(f"[{opening}{closing}]"))
        return F.when(unpaired, _mark_commas(body, opening, closing)).otherwise(
            F.replace(quick, F.lit(","), F.lit(_SPLIT_MARK))
        )

    return F.split(let(masked, marked), _SPLIT_MARK)


def _mark_commas(body: Column, opening: str, closing: str) -> Column:
    brackets = opening + closing
    pieces = F.regexp_extract_all(body, F.lit(f"[^{brackets},]+|[{brackets},]"), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        depth = (
            acc["depth"]
            + F.when(F.rlike(piece, F.lit(f"^[{opening}]")), 1).otherwise(0)
            - F.when(F.rlike(piece, F.lit(f"^[{closing}]")), 1).otherwise(0)
        )
        out = F.when((piece == ",") & (depth == 0), F.lit(_SPLIT_MARK)).otherwise(piece)
        return F.struct(depth.alias("depth"), F.concat(acc["text"], out).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(pieces, start, step)["text"]
