"""BPE encoding and decoding of whole texts as a tree of halves.

A text is halved until a part has at most ``leaf`` characters, wherever that cuts. The leaves
are encoded independently. Joining two halves re-encodes a window around the cut, which grows until on
either side it agrees exactly with the half there: two neighbours with a blank between, or
``AGREE`` tokens in a row where nothing is blank, have the same ids and places in both. What lies between
the two places of agreement is taken from the window, the rest from the halves. A window that has grown
over both halves is simply their encoding. The root is the encoding of the text.

Texts longer than ``spread`` characters have their leaves encoded as rows of their own, in any
task, and meet again for the joins; shorter ones are encoded in the task that reads them.

Agreement at a blank is exact for vocabularies whose tokens never reach over one; ``Codec`` takes only those.

A text of common Latin characters is first cut into words by the vocabulary's pattern and written with a mark
after each word. The tree is then one over this writing: its leaves are encoded by ranks, for which a token that ends
a word ends in the mark, and a blank is the place after a mark. Every other text goes to the library as it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm.alignment import byte_of_character
from quillmap.llm.common import query, table

#: Most characters of a leaf, and of a text that is not spread over tasks.
LEAF = 4096
SPREAD = 1 << 20

#: Equal tokens in a row on which a window and a half agree where there is no blank.
AGREE = 8

#: Characters on either side of a cut that the first window takes.
REACH = 128

#: Characters of texts that are encoded before rows are passed on.
PORTION = 512 << 10

#: Characters that lower case and normal form leave alone or map one to one, as Latin letters or none.
_COMMON = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
_SPECIAL = "<|"
#: It ends a word; no common text has it.
_MARK = "\x01"
_SUFFIX = "</w>"

Batches = Iterator[pa.RecordBatch]


class Tokens(NamedTuple):
    """Ids with the places in the text where each starts and ends."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def part(self, first: int, last: int) -> Tokens:
        return Tokens(self.ids[first:last], self.starts[first:last], self.ends[first:last])


def _after_each_other(*parts: Tokens) -> Tokens:
    return Tokens(*(np.concatenate(columns) for columns in zip(*parts)))


class Codec:
    """A tokenizer file whose tokens never reach over a blank."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        if '"Removed"' not in json.dumps(settings["pre_tokenizer"]) or any(" " in t["content"] for t in settings["added_tokens"]):
            raise ValueError("tokens of this vocabulary may reach over blanks")
        # Without a decoder, decoded tokens are put side by side with a blank between.
        self.plain = settings["decoder"] is None
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.token = [self.library.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        splits = [p["pattern"]["Regex"] for p in settings["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0])
        self.ranked = self.by_ranks(settings["model"])

    def by_ranks(self, model: dict) -> tiktoken.Encoding | None:
        """The same vocabulary for marked words, if its ids are in the order of its merges: bytes, bytes that end a word, merges."""
        byte = byte_of_character()
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        merges = [m[: -len(_SUFFIX)].replace(_SUFFIX, "") + _SUFFIX if m.endswith(_SUFFIX) else m for m in merges]
        ids = [model["vocab"].get(m) for m in merges]
        if model.get("end_of_word_suffix") != _SUFFIX or ids != list(range(512, 512 + len(merges))):
            return None
        ranks = {}
        for token, i in model["vocab"].items():
            if i < 512 + len(merges):
                ends = token.endswith(_SUFFIX)
                spelled = token[: -len(_SUFFIX)] if ends else token
                ranks[bytes(map(byte.__getitem__, spelled)) + _MARK.encode() * ends] = i
        # The mark itself stands where its byte would; at the end of a word it is always merged.
        ranks[_MARK.encode()] = len(self.token)
        self.lengths = np.zeros(len(self.token) + 1, np.int64)
        self.closes = np.zeros(len(self.token) + 1, bool)
        for spelled, i in ranks.items():
            self.lengths[i] = sum(b & 0xC0 != 0x80 for b in spelled)
            self.closes[i] = spelled.endswith(_MARK.encode())
        return tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}?|{_MARK}", mergeable_ranks=ranks, special_tokens={})

    def prepared(self, text: str) -> tuple[str, bool]:
        """What the tree is over, and whether that is marked words."""
        if self.ranked is None or _SPECIAL in text or not _COMMON.fullmatch(text):
            return text, False
        words = self.words.findall(text.lower())
        return "".join([f"{w}{_MARK}" for w in words]), True

    def decode(self, ids: list[int]) -> str:
        if self.plain:
            return " ".join(map(self.token.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)

    def tokens(self, start: int, text: str, marked: bool) -> Tokens:
        """Tokens of a part whose first character has the place ``start``."""
        if not marked:
            return self.placed(start, self.library.encode(text, add_special_tokens=False))
        ids = np.array(self.ranked.encode_ordinary(text), np.int64)
        ends = start + np.cumsum(self.lengths[ids])
        return Tokens(ids, ends - self.lengths[ids], ends)

    @staticmethod
    def placed(start: int, found) -> Tokens:
        places = np.array(found.offsets, np.int64).reshape(-1, 2) + start
        return Tokens(np.array(found.ids, np.int64), places[:, 0], places[:, 1])

    def after_blank(self, text: str, window: Tokens, marked: bool) -> np.ndarray:
        """Which tokens but the first begin after a blank."""
        if marked:
            return self.closes[window.ids[:-1]]
        gap = window.starts[1:] > window.ends[:-1]
        gap[gap] = [text[s - 1] == " " for s in window.starts[1:][gap]]
        return gap

    def join(self, text: str, left: Tokens, right: Tokens, start: int, cut: int, end: int, marked: bool) -> Tokens:
        """Tokens of ``text[start:end]`` from those of its halves around ``cut``."""
        reach = REACH
        while True:
            low, high = max(start, cut - reach), min(end, cut + reach)
            window = self.tokens(low, text[low:high], marked)
            blank = self.after_blank(text, window, marked)
            head = (0, 0) if low == start else _agreed(window, left, blank, last=False)
            tail = (len(window.ids), len(right.ids)) if high == end else _agreed(window, right, blank, last=True)
            if head is not None and tail is not None and head[0] <= tail[0]:
                return _after_each_other(left.part(0, head[1]), window.part(head[0], tail[0]), right.part(tail[1], len(right.ids)))
            reach *= 2

    def tree(self, text: str, cuts: list[int], leaves: list[Tokens], marked: bool) -> Tokens:
        """Join neighbours, level by level, until one node holds the whole text."""
        while len(leaves) > 1:
            joined = [
                self.join(text, leaves[i], leaves[i + 1], *cuts[i: i + 3], marked) for i in range(0, len(leaves), 2)
            ]
            leaves, cuts = joined, cuts[::2]
        return leaves[0]

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[list[int]]:
        """Ids of each text. Leaves for the library are encoded in one call."""
        out: list[list[int]] = []
        whole = []
        for i, text in enumerate(texts):
            written, marked = self.prepared(text)
            if len(written) > leaf:
                cuts = leaf_cuts(len(written), leaf)
                parts = [written[a:b] for a, b in zip(cuts, cuts[1:])]
                if marked:
                    leaves = [self.tokens(a, p, True) for a, p in zip(cuts, parts)]
                else:
                    leaves = [self.placed(a, e) for a, e in zip(cuts, self.library.encode_batch(parts, add_special_tokens=False))]
                out.append(self.tree(written, cuts, leaves, marked).ids.tolist())
            elif marked:
                out.append(self.ranked.encode_ordinary(written))
            else:
                whole.append(i)
                out.append([])
        for i, found in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def result(self, ids: list[int], full: bool) -> list:
        decoded = self.decode(ids)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(self.decimal.__getitem__, ids)), decoded)]
        return [len(ids), *digests, *((ids, decoded) if full else ())]


def leaf_cuts(length: int, leaf: int) -> list[int]:
    """Ends of the leaves: a power of two of nearly equal parts, none above ``leaf``."""
    parts = 1
    while parts * leaf < length:
        parts *= 2
    return [length * i // parts for i in range(parts + 1)]


def _agreed(window: Tokens, half: Tokens, blank: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Where, first or last in the window, window and half go on alike: the place in each. ``blank``: tokens after a blank."""
    if not len(window.ids) or not len(half.ids):
        return None
    at = np.minimum(np.searchsorted(half.starts, window.starts), len(half.ids) - 1)
    same = (half.ids[at] == window.ids) & (half.starts[at] == window.starts) & (half.ends[at] == window.ends)
    # Tokens that follow each other in both; parts of one character share a place and are never taken for a run.
    pair = same[1:] & same[:-1] & (np.diff(at) == 1) & (window.starts[1:] >= window.ends[:-1])
    gaps = np.flatnonzero(pair & blank) + 1
    sums = np.concatenate([[0], np.cumsum(pair)])
    ahead = sums[AGREE - 1:]
    runs = np.flatnonzero(ahead - sums[: len(ahead)] == AGREE - 1) + AGREE // 2
    found = np.concatenate([gaps, runs])
    if not len(found):
        return None
    w = int(found.max() if last else found.min())
    return w, int(at[w])


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    # Tasks are the unit of parallel work; the library's own threads would each keep memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _result_fields(full: bool) -> list[pa.Field]:
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return fields + [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if full else fields


def _with_results(keys: list[pa.Array], names: list[str], results: list[list], full: bool) -> pa.RecordBatch:
    fields = _result_fields(full)
    columns = [pa.array([r[i] for r in results], f.type) for i, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=[*names, *(f.name for f in fields)])


def _short(path: str, leaf: int, full: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = _codec(path)
        for batch in batches:
            first, size, held = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= PORTION or i + 1 == len(batch):
                    results = [codec.result(ids, full) for ids in codec.encode(held, leaf)]
                    yield _with_results([batch.column("id").slice(first, len(held))], ["id"], results, full)
                    first, size, held = i + 1, 0, []

    return run


def _leaves(path: str, leaf: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = _codec(path)
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text, marked = codec.prepared(text.as_py())
                cuts = leaf_cuts(len(text), leaf)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(i, 1), batch.column("hash").slice(i, 1), pa.array([k], pa.int32()),
                         pa.array([a], pa.int64()), pa.array([text[a:b]], pa.string()), pa.array([marked])],
                        names=["id", "hash", "leaf", "start", "text", "marked"],
                    )

    return run


def _encoded_leaves(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = _codec(path)
        for batch in batches:
            for i, (start, text, marked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "text", "marked")))):
                found = codec.tokens(start, text, marked)
                columns = [pa.array([c], pa.list_(pa.int64())) for c in found]
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, *columns], names=[*row.schema.names, "ids", "starts", "ends"])

    return run


def _joined(path: str, full: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        codec = _codec(path)
        rows = group.sort_by("leaf").to_pylist()
        copies = sum(r["leaf"] == 0 for r in rows)
        rows = rows[::copies]
        text = "".join(r["text"] for r in rows)
        leaves = [Tokens(*(np.array(r[c], np.int64) for c in Tokens._fields)) for r in rows]
        cuts = [*(r["start"] for r in rows), len(text)]
        result = codec.result(codec.tree(text, cuts, leaves, rows[0]["marked"]).ids.tolist(), full)
        ids = group.column("id").combine_chunks().slice(0, 1)
        batch = _with_results([ids], ["id"], [result], full)
        return pa.Table.from_batches([batch] * copies)

    return run


def encode_decode(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
    full: bool = False, leaf: int = LEAF, spread: int = SPREAD,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_tokens, ids_sha256, decoded_sha256``.

    With ``full`` also ``ids`` and ``decoded``. The digests are of the decimal ids joined by one
    blank and of the decoded text. Null and empty texts have no ids and decode to an
    empty text. Repeated rows each have their result. An empty table gives an empty
    table; other columns are not read. ``path`` names a tokenizer file that every worker can read.
    """
    given = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    id_type = given.schema["id"].dataType.simpleString()
    result = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    result += ", ids array<int>, decoded string" if full else ""
    is_long: Column = F.length("text") > spread
    short = given.where(~is_long).select("id", "text").mapInArrow(_short(path, leaf, full), result)
    leaf_rows = f"id {id_type}, hash bigint, leaf int, start bigint, text string, marked boolean"
    leaves = given.where(is_long).mapInArrow(_leaves(path, leaf), leaf_rows).repartition("id", "hash", "leaf")
    units = leaves.mapInArrow(
        _encoded_leaves(path), f"{leaf_rows}, ids array<bigint>, starts array<bigint>, ends array<bigint>"
    )
    # A group is one document.
    return short.union(units.groupBy("id", "hash").applyInArrow(_joined(path, full), result))


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row's ids and decoded text."""
    return encode_decode(docs, path, text, doc_id, full=True)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")
