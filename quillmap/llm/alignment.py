"""Tokens of two vocabularies aligned by lockstep vectorised merging.

A blank and the text are encoded by vocabulary A, the text by vocabulary B, which adds the blank itself.
Both sequences cut the same bytes. For all documents of a portion at once, one NumPy vector holds a pointer into
the A tokens and one a pointer into the B tokens. In each step every document links the two tokens
it points at; the pointer whose token ends first moves on, and if both end at one byte there is a cut and
both move. Finished documents are compacted away. A document of more than ``LANE`` A tokens takes
part as several lanes, each from an A token of its own and the B token that covers its first byte,
so that a long document does not leave the others behind.

Between two cuts lies a group: A and B tokens that spell the same bytes.

How many documents hold a pair of ids linked is counted over all documents. A portion is a
block: its documents name pairs by their place in the block's list, and the list is what is counted,
so a pair meets at most once per block however many documents hold it. The counts are joined back to the
lists by pair and brought to the documents by block, which is a portion of bounded size.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm.common import query, table, written
from quillmap.llm.tokens import plain_ids

#: Characters of texts that are aligned at once; a longer text is a portion of its own.
PORTION = 6 << 20

#: Texts that the libraries encode in one call.
AT_ONCE = 64

#: A tokens of a lane.
LANE = 512

Batches = Iterator[pa.RecordBatch]

_NONE = np.zeros(0, np.int64)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves,
    all others in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


def entry_bytes(library: Tokenizer) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary; added tokens stand for themselves."""
    byte = byte_of_character()
    out = []
    for i in range(library.get_vocab_size(with_added_tokens=True)):
        token = library.id_to_token(i) or ""
        out.append(bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode())
    return out


def piece_bytes(library: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece: U+2581 as a blank, and byte pieces as their byte."""
    out = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        out.append(bytes([int(piece[3:-1], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Merged(NamedTuple):
    """Links as places of their A and B tokens, in no order, and whether each token ends at a cut."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lanes(counts: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First A token and the one after the last of each lane, for documents of so many A tokens each."""
    parts = -(-counts // lane)
    first = np.repeat(np.cumsum(counts) - counts, parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return first + nth * lane, np.minimum(first + (nth + 1) * lane, np.repeat(np.cumsum(counts), parts))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, counts: np.ndarray, lane: int = LANE) -> Merged:
    """Merge the tokens of documents that lie one after the other on one axis of bytes.

    ``ends_a`` and ``ends_b`` are the tokens' end bytes on that axis, rising; ``counts`` are the A tokens of each document.
    """
    a, stop = lanes(counts, lane)
    begin = np.concatenate([[0], ends_a])[a]
    b = np.searchsorted(ends_b, begin, side="right")
    linked_a, linked_b = [_NONE], [_NONE]
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    while len(a):
        linked_a.append(a)
        linked_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        cut_a[a[cut]] = True
        cut_b[b[cut]] = True
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return Merged(np.concatenate(linked_a), np.concatenate(linked_b), cut_a, cut_b)


class Portion(NamedTuple):
    """Aligned tokens of some texts, all arrays over the texts one after the other."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    counts_a: np.ndarray
    counts_b: np.ndarray
    merged: Merged


class Aligner:
    def __init__(self, path_a: str, path_b: str, ranks_a: str | None = None) -> None:
        self.ranks_a = ranks_a
        # Tasks are the unit of parallel work.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = entry_bytes(self.a), piece_bytes(self.b)
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.pairs = len(self.bytes_a) * len(self.bytes_b)
        # Each id with what may follow it: another of its side, the other side, another group, nothing.
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.written = [f"{i}{mark}" for i in ids for mark in (",", "|", ";", "")]

    def by_a(self, texts: list[str]) -> list[list[int]]:
        """Ids by A. The rank file of the same vocabulary is faster for the texts on which both libraries agree."""
        known = [plain_ids(t, self.ranks_a, public_tokenizers.PATTERN) if self.ranks_a else None for t in texts]
        others = iter(self.a.encode_batch_fast([t for t, ids in zip(texts, known) if ids is None], add_special_tokens=False))
        return [next(others).ids if ids is None else ids for ids in known]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids by A and by B of each text; none where the bytes of the tokens are not those of the text."""
        for i in range(0, len(texts), AT_ONCE):
            some = texts[i: i + AT_ONCE]
            for text, ids, b in zip(some, self.by_a([f" {t}" for t in some]), self.b.encode(some, num_threads=1)):
                want = f" {text}".encode()
                same = text and all(
                    b"".join(map(entry.__getitem__, found)) == want for entry, found in ((self.bytes_a, ids), (self.bytes_b, b))
                )
                yield (ids, b) if same else ([], [])

    def portion(self, texts: list[str], lane: int = LANE) -> Portion:
        a, b, counts = [], [], []
        for ids_a, ids_b in self.encode(texts):
            a.append(np.array(ids_a, np.int64))
            b.append(np.array(ids_b, np.int64))
            counts.append((len(ids_a), len(ids_b)))
        ids_a, ids_b = np.concatenate([_NONE, *a]), np.concatenate([_NONE, *b])
        counts_a, counts_b = np.array(counts, np.int64).reshape(-1, 2).T
        ends = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        return Portion(ids_a, ids_b, counts_a, counts_b, lockstep(*ends, counts_a, lane))

    def group_digests(self, p: Portion) -> list[str]:
        """Digest of each document's groups, written as ``a1,a2|b1;a3|b2,b3``; empty for one without tokens."""
        cut_a, cut_b = p.merged.cut_a, p.merged.cut_b
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        # A group's A tokens come first, then its B tokens.
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=groups))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        last = np.zeros(len(cut_b), bool)
        last[np.cumsum(p.counts_b)[p.counts_b > 0] - 1] = True
        order = np.zeros(len(cut_a) + len(cut_b), np.int64)
        order[np.arange(len(cut_a)) + before_b[group_a]] = p.ids_a * 4 + cut_a
        order[np.arange(len(cut_b)) + before_a[group_b + 1]] = p.ids_b * 4 + np.where(last, 3, np.where(cut_b, 2, 0))
        ends = np.cumsum(p.counts_a + p.counts_b)
        return [
            hashlib.sha256("".join(map(self.written.__getitem__, order[s:e].tolist())).encode()).hexdigest() if s < e else ""
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())
        ]


#: Paths of A, of B, and of the rank file of A, if there is one.
Paths = tuple[str, str, str | None]

_aligners: dict[Paths, Aligner] = {}


def _aligner(paths: Paths) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _portions(batches: Batches, portion: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Identifiers and texts, up to ``portion`` characters at a time."""
    for batch in batches:
        first, size, held = 0, 0, []
        for i, text in enumerate(batch.column("text")):
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size >= portion or i + 1 == len(batch):
                yield batch.column("id").slice(first, len(held)), held
                first, size, held = i + 1, 0, []


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _of_documents(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


_COUNTED = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCKS = (
    "block bigint, id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "steps array<int>, times array<int>, pair_steps array<bigint>, pair_docs array<int>"
)


def _blocks(paths: Paths, portion: int) -> Callable[[Batches], Batches]:
    """Documents with their linked pairs, as rising places (each as the step from the one before) in the
    list of the block, and how often; then one row with the list itself."""

    def run(batches: Batches) -> Batches:
        aligner = _aligner(paths)
        task = TaskContext.get().partitionId()
        for nth, (ids, texts) in enumerate(_portions(batches, portion)):
            p = aligner.portion(texts)
            owner = np.repeat(np.arange(len(texts)), p.counts_a)
            pair = p.ids_a[p.merged.link_a] * len(aligner.bytes_b) + p.ids_b[p.merged.link_b]
            held, times = np.unique(owner[p.merged.link_a] * aligner.pairs + pair, return_counts=True)
            listed, place, docs = np.unique(held % aligner.pairs, return_inverse=True, return_counts=True)
            per_doc = np.bincount(held // aligner.pairs, minlength=len(texts))
            step = np.diff(place, prepend=0)
            starts = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
            step[starts] = place[starts]
            n_links = np.bincount(owner[p.merged.link_a], minlength=len(texts))
            n, none = len(texts), np.zeros(len(texts), np.int64)
            block = (task << 32) + nth
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), ids, pa.array(p.counts_a), pa.array(p.counts_b),
                 pa.array(_of_documents(p.merged.cut_a, p.counts_a)), pa.array(n_links), pa.array(aligner.group_digests(p), pa.string()),
                 _lists(step, per_doc, pa.int32()), _lists(times, per_doc, pa.int32()),
                 _lists(_NONE, none, pa.int64()), _lists(_NONE, none, pa.int32())],
                names=["block", "id", *_COUNTED, "groups_sha256", "steps", "times", "pair_steps", "pair_docs"],
            )
            whole, nothing = np.array([len(listed)]), np.array([0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, ids.type), *([pa.nulls(1, pa.int64())] * 4), pa.nulls(1, pa.string()),
                 _lists(_NONE, nothing, pa.int32()), _lists(_NONE, nothing, pa.int32()),
                 _lists(np.diff(listed, prepend=0), whole, pa.int64()), _lists(docs, whole, pa.int32())],
                names=["block", "id", *_COUNTED, "groups_sha256", "steps", "times", "pair_steps", "pair_docs"],
            )

    return run


def _listed(batches: Batches) -> Batches:
    """The rows of the blocks' lists."""
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            steps = batch.column("pair_steps")[i].values.to_numpy()
            docs = batch.column("pair_docs")[i].values
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.cumsum(steps)), pa.array(np.full(len(steps), block)), pa.array(np.arange(len(steps), dtype=np.int32)), docs],
                names=["pair", "block", "place", "docs"],
            )


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links; ``pairs`` has place, count and best of each listed pair."""
    order = np.argsort(pairs.column("place").to_numpy())
    count = pairs.column("count").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order]
    docs = docs.combine_chunks()
    steps, times = (docs.column(c).combine_chunks() for c in ("steps", "times"))
    per_doc = steps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    step, time = steps.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    # Places are sums of steps since the document's first.
    total = np.cumsum(step, dtype=np.int64)
    starts = np.cumsum(per_doc) - per_doc
    place = total - np.repeat(np.concatenate([[0], total])[starts], per_doc)
    out = docs.select(["id", *_COUNTED, "groups_sha256"])
    for name, values in (("n_best", best[place] * time), ("count_sum", count[place] * time)):
        out = out.append_column(name, pa.array(_of_documents(values, per_doc), pa.int64()))
    return out


def alignment_counts(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id",
    ranks_a: str | None = None, portion: int = PORTION,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    Links are all pairs of an A and a B token whose byte ranges overlap. ``n_best`` counts the links whose pair of ids
    is in as many documents as the best pair of its A id; ``count_sum`` adds up the number of documents that hold
    the link's pair. ``path_a`` names a byte-level vocabulary (``ranks_a`` the same as a rank file, if there is one),
    ``path_b`` one of pieces that puts a blank before the text; every worker can read them. Null and empty texts, and texts that either vocabulary does not spell
    byte by byte, have zeros and an empty digest. Repeated rows each count. An empty table gives an empty
    table; other columns are not read. A text of any length is aligned whole.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    blocks = written(given.mapInArrow(_blocks((path_a, path_b, ranks_a), portion), _BLOCKS.format(id=id_type)), "aligned-blocks")
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

    lists = blocks.where("n_a is null").select("block", "pair_steps", "pair_docs")
    listed = lists.mapInArrow(_listed, "pair bigint, block bigint, place int, docs int")
    counts = written(listed.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    counts = counts.withColumn("a", F.floor(F.col("pair") / width))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
    named = listed.select("pair", "block", "place").join(known, "pair").select("block", "place", "count", "best")

    rows = blocks.where("n_a is not null").drop("pair_steps", "pair_docs")
    result = f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    # A group is one block.
    return rows.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_summed, result)


def _aligned(paths: Paths) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        aligner = _aligner(paths)
        for ids, texts in _portions(batches, PORTION):
            p = aligner.portion(texts)
            order = np.lexsort((p.merged.link_b, p.merged.link_a))
            link_a, link_b = p.merged.link_a[order], p.merged.link_b[order]
            owner = np.repeat(np.arange(len(texts)), p.counts_a)[link_a]
            per_doc = np.bincount(owner, minlength=len(texts))
            first_a, first_b = np.cumsum(p.counts_a) - p.counts_a, np.cumsum(p.counts_b) - p.counts_b
            columns = [
                _lists(p.ids_a, p.counts_a, pa.int32()), _lists(p.ids_b, p.counts_b, pa.int32()),
                _lists(link_a - first_a[owner], per_doc, pa.int32()), _lists(link_b - first_b[owner], per_doc, pa.int32()),
                _lists(p.merged.cut_a, p.counts_a, pa.bool_()), _lists(p.merged.cut_b, p.counts_b, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "ids_a", "ids_b", "link_a", "link_b", "cut_a", "cut_b"])

    return run


def alignments(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", ranks_a: str | None = None,
) -> DataFrame:
    """The alignments themselves, one row per row of ``docs``, by the rules of ``alignment_counts``.

    ``ids_a, ids_b`` are the token ids, ``link_a, link_b`` the places of linked tokens in them, in order, and
    ``cut_a, cut_b`` tell which tokens end where one of the other vocabulary ends.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    lists = "ids_a array<int>, ids_b array<int>, link_a array<int>, link_b array<int>, cut_a array<boolean>, cut_b array<boolean>"
    return given.mapInArrow(_aligned((path_a, path_b, ranks_a)), f"id {given.schema['id'].dataType.simpleString()}, {lists}")


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ranks_a = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = alignment_counts(table(spark, sf_dir, "documents"), path_a, path_b, ranks_a=ranks_a).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", *_COUNTED, "n_best", "count_sum", "groups_sha256")
