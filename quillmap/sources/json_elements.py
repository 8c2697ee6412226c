"""JSON documents of any size as rows: one per element of their outermost arrays.

A document is dealt with in chunks, which any task can read. Whether a chunk begins inside a string, and in which
brackets, depends on all chunks before it. So each chunk is first summed up for both cases: how many quotes it has
and which brackets it closes and opens. A pass over the few summaries of a document gives every chunk its
beginning. Then each chunk is split by itself: what lies in an outermost array, at any depth of objects, becomes rows
of elements, and everything else the head of the document, which is small. Elements that reach over chunks are put
together again; no task holds more than one of them.

Head and elements are read strictly: a document is malformed if any of them is, or if brackets do not match.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillmap.plans.joins import small_side, tasks
from quillmap.plans.storage import materialize

#: Characters of a chunk.
CHUNK = 1 << 20

_OPENERS = {"}": "{", "]": "["}
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_BRACKETS, _STRUCTURE = (np.isin(np.arange(256), list(chars)) for chars in (b"{}[]", b"{}[],"))

Batches = Iterator[pa.RecordBatch]

#: A batch of rows made in Python ends after so many rows or characters.
_ROWS, _CHARS = 10_000, 8 << 20


class JsonDocuments(NamedTuple):
    """``heads``: ``repo, doc, kind, kinds, texts``, one row per document. ``kind`` is that of the whole document, NULL
    if it is malformed; of an object, ``kinds`` has the kind of each value and ``texts`` those that are no object or
    array as text. ``elements``: ``repo, doc, path, at, element, kind, kinds`` of the documents that are not malformed:
    the keys that lead to the array, the element's place in it, its JSON text, its kind, and that of its values."""

    heads: DataFrame
    elements: DataFrame


# --- reading small texts strictly ---------------------------------------------


def _refuse(name: str) -> None:
    raise ValueError(name)


# Numbers of any length are read, and none is turned into a long integer.
_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=float)
_MALFORMED = object()


def _parse(text: str | None) -> object:
    try:
        return _MALFORMED if text is None else _DECODER.decode(text)
    except (ValueError, RecursionError):
        return _MALFORMED


def _kind(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    return {str: "STRING", float: "NUMBER", dict: "OBJECT", list: "ARRAY"}[type(value)]


def _text(value: object) -> str | None:
    """A scalar as text, numbers without a needless fraction."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value.is_integer() and abs(value) < 1e21 else str(value)
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _kinds(value: object) -> list[tuple[str, str]]:
    if not isinstance(value, dict):
        return []
    return list({k.encode("utf-8", "replace").decode(): _kind(v) for k, v in value.items()}.items())


def _are_json(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _parse(t) is not _MALFORMED for t in texts.to_pylist()], pa.bool_())


_is_json = F.arrow_udf(_are_json, BooleanType())


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value; NULL for NULL."""
    return _is_json(text)


# --- chunks and what they begin in --------------------------------------------


def document_chunks(documents: DataFrame, value: str, size: int = CHUNK) -> DataFrame:
    """``repo, doc, at, text``: documents cut into chunks, which do not end in a backslash. ``doc`` numbers the documents."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            source: list[int] = []
            places: list[int] = []
            rows: list[str] = []
            held = 0

            def done() -> pa.RecordBatch:
                of = pa.array(source, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(of) for c in ("repo", "doc")), pa.array(places, pa.int64()), pa.array(rows, pa.string())],
                    names=["repo", "doc", "at", "text"])

            for i, text in enumerate(batch.column("value")):
                text, start, at = text.as_py(), 0, 0
                while not at or start < len(text):
                    end = start + size
                    while text[end - 1: end] == "\\":
                        end += 1
                    source.append(i)
                    places.append(at)
                    rows.append(text[start:end])
                    held += len(rows[-1])
                    start, at = end, at + 1
                    if len(rows) >= _ROWS or held >= _CHARS:
                        yield done()
                        source, places, rows, held = [], [], [], 0
            if rows:
                yield done()

    given = documents.select("repo", F.monotonically_increasing_id().alias("doc"), F.coalesce(F.col(value), F.lit("")).alias("value"))
    repo = given.schema["repo"].dataType.simpleString()
    return given.repartition(tasks(given), "doc").mapInArrow(cut, f"repo {repo}, doc bigint, at bigint, text string")


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are outside strings, and whether the chunk ends inside one."""
    quotes = data == _QUOTE
    slashes = data == _BACKSLASH
    if slashes.any():
        places = np.arange(len(data))
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(slashes, -1, places))[:-1]])
        quotes &= (places - 1 - before) % 2 == 0
    odd = np.cumsum(quotes) % 2 == 1
    return (odd if inside else ~odd) & ~quotes, bool(len(odd) and odd[-1]) != inside


def _reduced(brackets: str, stack: list[str]) -> str | None:
    """Apply brackets to a stack of open ones; what they close below it, or None if they do not match."""
    below = []
    for c in brackets:
        if c in "{[":
            stack.append(c)
        elif not stack:
            below.append(_OPENERS[c])
        elif stack.pop() != _OPENERS[c]:
            return None
    return "".join(below)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _summaries(batches: Batches) -> Batches:
    names = ["doc", "at", "odd", "closes_out", "opens_out", "closes_in", "opens_in"]
    for batch in batches:
        rows = []
        for doc, at, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "at", "text"))):
            data = _bytes(text)
            row = [doc, at, _outside(data, False)[1]]
            for inside in (False, True):
                stack: list[str] = []
                closes = _reduced(data[_outside(data, inside)[0] & _BRACKETS[data]].tobytes().decode(), stack)
                row += [closes, "".join(stack)]
            rows.append(row)
        yield pa.RecordBatch.from_arrays([
            pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, [pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 4])
        ], names=names)


_SUMMARY = "doc bigint, at bigint, odd boolean, closes_out string, opens_out string, closes_in string, opens_in string"
_BEGINNING = "doc bigint, at bigint, inside boolean, open string, fits boolean"


def _by_document(fn: Callable[[list[dict]], list[tuple]], fields: list[tuple[str, pa.DataType]]) -> Callable[[Batches], Batches]:
    """Apply ``fn`` to the rows of each document. Rows come in order of documents and chunks, and many documents
    go through one call, since a group of Spark's for each of many small ones costs far more than its rows."""

    def documents(batches: Batches) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["doc"] != row["doc"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Batches) -> Batches:
        return _in_batches((row for held in documents(batches) for row in fn(held)), fields)

    return run


def _in_batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], text: int | None = None) -> Batches:
    """Rows as batches of bounded size; ``text`` is the place of a column of long texts."""
    held: list[tuple] = []
    chars = 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        chars += len(row[text] or "") if text is not None else 0
        if len(held) >= _ROWS or chars >= _CHARS:
            yield done()
            held, chars = [], 0
    if held:
        yield done()


def _each_document(df: DataFrame, fn: Callable[[list[dict]], list[tuple]], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """``fn`` over all rows of each ``doc`` in order of ``at``; no document is in two parts."""
    return df.repartition(tasks(df), "doc").sortWithinPartitions("doc", "at").mapInArrow(_by_document(fn, fields), ddl)


_BEGINNING_FIELDS = [("doc", pa.int64()), ("at", pa.int64()), ("inside", pa.bool_()), ("open", pa.string()), ("fits", pa.bool_())]


def _beginnings(chunks: list[dict]) -> list[tuple]:
    """What each chunk of a document begins in, and whether all brackets of the document match."""
    rows, inside, stack, fits = [], False, "", True
    for r in chunks:
        rows.append((r["doc"], r["at"], inside, stack))
        closes, opens = (r["closes_in"], r["opens_in"]) if inside else (r["closes_out"], r["opens_out"])
        # Closed brackets are listed from the innermost outwards.
        fits = fits and closes is not None and stack.endswith(closes[::-1])
        stack = stack[: len(stack) - len(closes)] + opens if fits else ""
        inside ^= r["odd"]
    fits = fits and not inside and not stack
    return [(*r, fits) for r in rows]


# --- splitting a chunk ---------------------------------------------------------


class Split(NamedTuple):
    """``head``: the text outside arrays, cut wherever the content of an array lies; the first part is empty if the
    chunk begins in an array. ``pieces``: number of the array in the chunk (0 if open before), place of the element
    among those here, the text, whether the element ends here, and whether the array does with it. ``left``:
    separators here in the array that is open at the end, None if there is none."""

    head: list[str]
    pieces: list[tuple[int, int, str, bool, bool]]
    left: int | None


def split_chunk(text: str, inside: bool, stack: str) -> Split:
    data = text.encode()
    flat = np.frombuffer(data, np.uint8)
    places = np.flatnonzero(_outside(flat, inside)[0] & _STRUCTURE[flat])
    chars = flat[places]
    depth = len(stack) + np.cumsum(np.isin(chars, list(b"{[")).astype(int) - np.isin(chars, list(b"}]")).astype(int))
    openers = np.flatnonzero(chars == ord("["))
    at_depth: dict[int, np.ndarray] = {}

    def reaching(level: int) -> np.ndarray:
        if level not in at_depth:
            at_depth[level] = np.flatnonzero(depth == level)
        return at_depth[level]

    head, pieces = [], []
    array, level = 0, stack.find("[") + 1
    i = cursor = 0
    left = None
    if level:
        head.append("")
    while True:
        if level:
            # The bracket that closes the array is the first place below its depth.
            below = reaching(level - 1)
            k = int(np.searchsorted(below, i))
            closing = int(below[k]) if k < len(below) else None
            same = reaching(level)
            same = same[np.searchsorted(same, i): len(same) if closing is None else np.searchsorted(same, closing)]
            commas = places[same[chars[same] == ord(",")]].tolist()
            for n, comma in enumerate(commas):
                pieces.append((array, n, data[cursor:comma].decode(), True, False))
                cursor = comma + 1
            end = len(data) if closing is None else int(places[closing])
            pieces.append((array, len(commas), data[cursor:end].decode(), closing is not None, closing is not None))
            if closing is None:
                left = len(commas)
                break
            cursor, i, level = end, closing + 1, 0
        else:
            k = bisect_left(openers, i)
            if k == len(openers):
                head.append(data[cursor:].decode())
                break
            opener = int(openers[k])
            end = int(places[opener]) + 1
            head.append(data[cursor:end].decode())
            array, level, cursor, i = array + 1, int(depth[opener]), end, opener + 1
    return Split(head, pieces, left)


_PIECE = "doc bigint, at bigint, arr int, nth bigint, text string, ends boolean, closes boolean, head array<string>, since bigint"


def _pieces(batches: Batches) -> Batches:
    """Pieces of elements, and for each chunk one row with its part of the head."""
    fields = [("doc", pa.int64()), ("at", pa.int64()), ("arr", pa.int32()), ("nth", pa.int64()), ("text", pa.string()),
              ("ends", pa.bool_()), ("closes", pa.bool_()), ("head", pa.list_(pa.string())), ("since", pa.int64())]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, at = row["doc"], row["at"]
                split = split_chunk(row["text"], row["inside"], row["open"])
                yield from ((doc, at, *p, None, None) for p in split.pieces)
                yield doc, at, None, None, None, None, None, split.head, split.left

    return _in_batches(rows(), fields, text=4)


# --- putting documents together --------------------------------------------------

_ARRAYS = (
    "doc bigint, at bigint, first bigint, current bigint, before bigint, number bigint, path array<string>, "
    "kind string, kinds map<string,string>, texts map<string,string>"
)
_ELEMENT = "doc bigint, number bigint, nth bigint, text string"


def _paths(value: object, path: list[str]) -> Iterator[tuple[int, list[str]]]:
    if isinstance(value, list):
        yield int(value[0]), path
    elif isinstance(value, dict):
        for key, child in value.items():
            yield from _paths(child, [*path, key.encode("utf-8", "replace").decode()])


_WORDS = pa.map_(pa.string(), pa.string())
_ARRAY_FIELDS = [
    *((name, pa.int64()) for name in ("doc", "at", "first", "current", "before", "number")),
    ("path", pa.list_(pa.string())), ("kind", pa.string()), ("kinds", _WORDS), ("texts", _WORDS),
]


def _assembled(parts: list[dict]) -> list[tuple]:
    """From the head parts of a document: where the chunks' arrays come in the document, what leads to each, and the head."""
    text, rows, arrays, before, within = [], [], 0, 0, False
    doc = parts[0]["doc"]

    def begin_array() -> None:
        nonlocal arrays
        text.append(str(arrays))
        arrays += 1

    for r in parts:
        head, left = r["head"], r["since"]
        rows.append((doc, r["at"], arrays, arrays - 1, before, None, None, None, None, None))
        text.append(head[0])
        for n, part in enumerate(head[1:]):
            if n or not within:
                begin_array()
            text.append(part)
        if left is not None:
            if len(head) > 1 or not within:
                begin_array()
                before = 0
            before += left
        within = left is not None
    value = _parse("".join(text))
    none = (None,) * 4
    if value is _MALFORMED:
        return [*rows, (doc, *none, None, *none)]
    texts = [(k, t) for k, v in value.items() if (t := _text(v)) is not None] if isinstance(value, dict) else []
    rows.append((doc, *none, None, None, _kind(value), _kinds(value), texts))
    return rows + [(doc, *none, n, path, None, None, None) for n, path in _paths(value, [])]


def _checked(batches: Batches) -> Batches:
    """Elements with their kind, NULL if malformed, and the kinds of their values."""
    for batch in batches:
        values = [_parse(t) for t in batch.column("text").to_pylist()]
        kinds = pa.array([None if v is _MALFORMED else _kind(v) for v in values], pa.string())
        inner = pa.array([_kinds(v) for v in values], pa.map_(pa.string(), pa.string()))
        yield batch.append_column("kind", kinds).append_column("kinds", inner)


def read_json(documents: DataFrame, value: str = "value", size: int = CHUNK) -> JsonDocuments:
    """``repo`` and JSON text to heads and elements. Nulls count as malformed; rows that share a repository are
    documents of their own. Of keys that occur twice in an object the last counts."""
    chunks = materialize(document_chunks(documents, value, size), "json-chunks")
    summaries = chunks.select("doc", "at", "text").mapInArrow(_summaries, _SUMMARY)
    begins = materialize(_each_document(summaries, _beginnings, _BEGINNING_FIELDS, _BEGINNING), "json-beginnings")
    begun = chunks.select("doc", "at", "text").join(small_side(begins.where("fits").drop("fits")), ["doc", "at"])
    pieces = materialize(begun.mapInArrow(_pieces, _PIECE), "json-pieces")
    parts = pieces.where("head is not null").select("doc", "at", "head", "since")
    found = materialize(_each_document(parts, _assembled, _ARRAY_FIELDS, _ARRAYS), "json-heads")

    earlier = F.col("arr") == 0
    goes_on = earlier & (F.col("nth") == 0)
    placed = pieces.where("head is null").join(small_side(found.where("at is not null").select("doc", "at", "first", "current", "before")), ["doc", "at"])
    placed = placed.select(
        "doc", "at", F.when(earlier, F.col("current")).otherwise(F.col("first") + F.col("arr") - 1).alias("number"),
        F.when(earlier, F.col("before") + F.col("nth")).otherwise(F.col("nth")).alias("nth"), "text", "closes",
        (F.col("ends") & ~goes_on).alias("whole"),
    )
    # A group is one element.
    joined = placed.where("not whole").groupBy("doc", "number", "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("text"),
        F.max("closes").alias("closes"),
    )
    every = placed.where("whole").select("doc", "number", "nth", "text", "closes").unionByName(joined)
    empty_array = F.col("closes") & (F.col("nth") == 0) & ~F.col("text").rlike(r"[^ \t\n\r]")
    given = every.where(~empty_array).select("doc", "number", "nth", "text")
    checked = materialize(given.mapInArrow(_checked, f"{_ELEMENT}, kind string, kinds map<string,string>"), "json-elements")

    bad = checked.where("kind is null").select("doc").distinct().withColumn("bad", F.lit(True))
    tops = found.where("at is null and number is null").select("doc", "kind", "kinds", "texts")
    heads = chunks.where("at = 0").select("doc", "repo").join(tops, "doc", "left").join(bad, "doc", "left")
    heads = materialize(heads.select("repo", "doc", F.when(F.col("bad").isNull(), F.col("kind")).alias("kind"), "kinds", "texts"), "json-documents")
    paths = found.where("number is not null").select("doc", "number", "path").join(heads.where("kind is not null").select("doc", "repo"), "doc")
    elements = checked.join(small_side(materialize(paths, "json-paths")), ["doc", "number"])
    return JsonDocuments(heads, elements.select("repo", "doc", "path", F.col("nth").alias("at"), F.col("text").alias("element"), "kind", "kinds"))
