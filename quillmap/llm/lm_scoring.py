"""Cross-entropy difference of a target and a background language model.

Both models are n-grams of characters in lower case over one shared vocabulary: all characters and all n-grams of the
corpus, which grow with it. Target counts are taken over all documents that are labelled good, background counts
over all documents, and both models are smoothed alike: each order adds ``PRIOR`` observations that follow
the next shorter one, the shortest is backed by equal chances for all characters. The tokens of a text are its characters.
A token's loss is in bits; a document's score is the mean over its tokens of the loss under the target model less that
under the background model; lower is more like the target.

Documents are dealt with in blocks. A block counts its own n-grams, so what is shuffled is at most one row for each
n-gram of a block. Summed rows are the models, kept as a table. The losses are joined back to the rows of the
blocks by n-gram, and meet the texts by block, which is a portion of bounded size. The texts of a block are one
compressed row, since they are both stored and shuffled. Of a whole block a task holds only narrow arrays; what is
wider, texts included, is held for a slice of it at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import query, small_side, table, written

#: Characters of an n-gram.
ORDER = 5

#: Observations by which the shorter context weighs against counts.
PRIOR = 4.0

#: Characters of a block; a longer text is a block of its own.
PORTION = 8 << 20

#: Places dealt with at a time where an array of them would be wide.
_SLICE = 1 << 19

#: Rows of n-grams that are made at a time.
_ROWS = 1 << 16

#: It stands before the first character of a text, for as many as an n-gram needs.
_START = "\x02"

Batches = Iterator[pa.RecordBatch]


def _slices(n: int, size: int | None = None) -> list[slice]:
    size = size or _SLICE
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


def _longer(begun: np.ndarray, codes: np.ndarray, new: range, size: int, n: int) -> tuple[np.ndarray, int]:
    """Numbered beginnings of ``n`` n-grams and the places of their next codes to the longer ones, numbered in order.
    Only a slice of them is held as wide numbers at a time. Numbers of an earlier call are overwritten."""
    which, found = begun if begun.dtype == np.int32 else np.empty(n, np.int32), []
    for part in _slices(n):
        grams = begun[part].astype(np.int64)
        for j in new:
            grams *= size
            grams += codes[part.start + j: part.stop + j]
        encoded = pa.array(grams).dictionary_encode()
        found.append(encoded.dictionary.to_numpy(zero_copy_only=False))
        which[part] = encoded.indices.to_numpy(zero_copy_only=False)
    del encoded
    # What Arrow has freed would stay with the process.
    pa.default_memory_pool().release_unused()
    different = np.unique(np.concatenate(found))
    for part, own in zip(_slices(n), found):
        which[part] = np.searchsorted(different, own).astype(np.int32)[which[part]]
    return which, len(different)


def _unique_rows(codes: np.ndarray, size: int, order: int) -> tuple[np.ndarray, int]:
    """The different n-grams of a row of codes below ``size`` in order of their codes: which of them begins where, and their number."""
    which, span, done = codes, size, 1
    while done < order:
        # As many codes as one number holds.
        wide, end = span, done
        while end < order and wide * size < 1 << 62:
            wide, end = wide * size, end + 1
        which, span = _longer(which, codes, range(done, end), size, len(codes) - order + 1)
        done = end
    return which if order > 1 else codes.astype(np.int32), span


def _pieces(texts: Iterable[str], order: int) -> Iterator[str]:
    """The texts one after the other, each behind its starts, in strings of about a slice."""
    held, size = [], 0
    for text in texts:
        held.append(_START * (order - 1))
        for part in _slices(len(text)):
            held.append(text[part])
            size += len(held[-1])
            if size >= _SLICE:
                yield "".join(held)
                held, size = [], 0
    yield "".join(held)


def _codes(texts: Iterable[str], n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` characters of the texts and their starts as places in the alphabet of these, and its code points."""
    points, end = np.empty(n, np.uint32), 0
    for piece in _pieces(texts, order):
        found = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        points[end: end + len(found)] = found
        end += len(found)
    occurs = np.zeros(int(points.max()) + 1, bool)
    for part in _slices(n):
        occurs[points[part]] = True
    alphabet = np.flatnonzero(occurs).astype(np.uint32)
    place = np.zeros(len(occurs), np.min_scalar_type(len(alphabet)))
    place[alphabet] = np.arange(len(alphabet))
    codes = np.empty(n, place.dtype)
    for part in _slices(n):
        codes[part] = place[points[part]]
    return codes, alphabet


def _numbered(texts: Iterable[str], sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the different n-grams that end in a character of a text ends at each character, text after text; a place
    where each of them begins; the codes at all places, and the code points these stand for. ``sizes`` are the texts' characters."""
    if not sizes.sum():
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
    # The n-gram at place p ends in p + order - 1; those that end in a start are of no text.
    ends = np.cumsum(sizes + order - 1)
    codes, alphabet = _codes(texts, int(ends[-1]), order)
    which, count = _unique_rows(codes, len(alphabet), order)
    inside = np.ones(len(which), bool)
    for k in range(order - 1):
        gone = ends[:-1] + k - (order - 1)
        inside[gone[gone >= 0]] = False
    # Any place where an n-gram stands will do to read it.
    at = np.full(count, -1, np.int32)
    for part in _slices(len(which)):
        chosen = np.flatnonzero(inside[part])
        at[which[part][chosen]] = chosen + part.start
    used = at >= 0
    renumbered = np.cumsum(used, dtype=np.int32) - np.int32(1)
    end = 0
    for part in _slices(len(which)):
        own = renumbered[which[part][inside[part]]]
        which[end: end + len(own)] = own
        end += len(own)
    return which[:end], at[used], codes, alphabet


def _counts(which: np.ndarray, m: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """How often each number below ``m`` occurs, or does so where ``chosen`` holds."""
    counts = np.zeros(m, np.int64)
    for part in _slices(len(which)):
        counts += np.bincount(which[part] if chosen is None else which[part][chosen[part]], minlength=m)
    return counts


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of code points as an Arrow array, without a Python string for each."""
    data = np.ascontiguousarray(rows).astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
    widths = 1 + (rows >= 0x80).sum(1, dtype=np.int64) + (rows >= 0x800).sum(1) + (rows >= 0x10000).sum(1) + rows.shape[1] - 1
    offsets = np.concatenate([[0], np.cumsum(widths)])
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _grams(at: np.ndarray, codes: np.ndarray, alphabet: np.ndarray, order: int) -> Iterator[pa.Array]:
    """The n-grams that begin at the places, some at a time."""
    for part in _slices(len(at), _ROWS):
        yield _strings(alphabet[codes[at[part][:, None] + np.arange(order)]])


def grams_of(texts: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different n-grams that end in a character of a text, which of them ends at each character, text after text,
    and the number of characters of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    which, *rest = _numbered(texts, sizes, order)
    return [g for some in _grams(*rest, order) for g in some.to_pylist()], which, sizes


def _packed(texts: pa.Array) -> bytes:
    """Texts one after the other, compressed together."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for text in texts:
            if text.is_valid:
                out.write(text.as_buffer())
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes | pa.Buffer, sizes: list[int]) -> Iterator[str]:
    """The texts of ``sizes`` characters that were compressed together, one at a time."""
    with pa.CompressedInputStream(pa.BufferReader(packed), "zstd") as held:
        # No line ending is translated.
        whole = io.TextIOWrapper(held, "utf-8", newline="\n")
        for size in sizes:
            yield whole.read(size)


_BLOCK = "block bigint, ids array<{id}>, sizes array<int>, texts binary, place int, gram string, target bigint, background bigint"


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v).cast(schema.field(k).type) for k, v in columns.items()], schema=schema)


def _blocks(schema: pa.Schema, portion: int) -> Callable[[Batches], Batches]:
    """One row for the texts of a block, and one for each n-gram of it."""

    def portions(batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, size = 0, 0
            for i, n in enumerate(sizes.tolist()):
                size += n
                if size >= portion or i + 1 == len(batch):
                    yield batch.slice(first, i + 1 - first), sizes[first: i + 1]
                    first, size = i + 1, 0

    def run(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        for nth, (docs, sizes) in enumerate(portions(batches)):
            block = (task << 32) + nth
            ids, texts = docs.column("id"), docs.column("text")
            yield _batch({
                "block": [block], "ids": pa.ListArray.from_arrays([0, len(ids)], ids), "sizes": [sizes.tolist()],
                "texts": [_packed(texts)], "place": pa.nulls(1), "gram": pa.nulls(1), "target": pa.nulls(1), "background": pa.nulls(1),
            }, schema)
            which, *rest = _numbered((t.as_py() or "" for t in texts), sizes, ORDER)
            m = len(rest[0])
            background = _counts(which, m)
            target = _counts(which, m, np.repeat(docs.column("good").to_numpy(zero_copy_only=False), sizes))
            del which
            for part, grams in zip(_slices(m, _ROWS), _grams(*rest, ORDER)):
                n = len(grams)
                yield _batch({
                    "block": np.full(n, block), "ids": pa.nulls(n), "sizes": pa.nulls(n), "texts": pa.nulls(n), "place": np.arange(part.start, part.stop, dtype=np.int32),
                    "gram": grams, "target": target[part], "background": background[part],
                }, schema)
            del rest, target, background
            pa.default_memory_pool().release_unused()

    return run


def models(counts: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``gram, target, background`` with counts of the longest n-grams to ``gram, loss_target, loss_background``."""
    kinds = ["target", "background"]
    chances = None
    for n in range(1, order + 1):
        level = counts.select(F.substring("gram", order - n + 1, n).alias("gram"), *kinds).groupBy("gram").agg(*(F.sum(k).alias(k) for k in kinds))
        if n == 1:
            level = written(level, "character-counts")
            whole = level.agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in kinds)).first()
            smooth = [(F.col(k) + prior / max(whole.n, 1)) / (F.lit(float(whole[k] or 0)) + prior) for k in kinds]
            chances = level.select("gram", *(c.alias(f"p_{k}") for c, k in zip(smooth, kinds)))
            continue
        level = level.withColumn("context", F.substring("gram", 1, n - 1)).withColumn("shorter", F.substring("gram", 2, n - 1))
        contexts = level.groupBy("context").agg(*(F.sum(k).alias(f"of_{k}") for k in kinds))
        shorter = chances.select(F.col("gram").alias("shorter"), *(F.col(f"p_{k}").alias(f"s_{k}") for k in kinds))
        joined = level.join(contexts, "context").join(shorter, "shorter")
        smooth = [(F.col(k) + prior * F.col(f"s_{k}")) / (F.col(f"of_{k}") + prior) for k in kinds]
        chances = written(joined.select("gram", *(c.alias(f"p_{k}") for c, k in zip(smooth, kinds))), f"chances-{n}")
    return chances.select("gram", *((-F.log2(f"p_{k}")).alias(f"loss_{k}") for k in kinds))


def _scores(texts: pa.Table, losses: pa.Table) -> pa.Table:
    """Identifiers of one block's texts with the means of their tokens' losses; ``losses`` has those of the block's n-grams by place."""
    packed = [(p.as_buffer(), s.as_py()) for p, s in zip(texts.column("texts"), texts.column("sizes"))]
    sizes = np.array([n for _, of in packed for n in of], np.int64)
    which = _numbered((t for p, of in packed for t in _unpacked(p, of)), sizes, ORDER)[0]
    place = losses.column("place").to_numpy()
    ends = np.cumsum(sizes)
    means = []
    for kind in ("target", "background"):
        loss = np.empty(len(place))
        loss[place] = losses.column(f"loss_{kind}").to_numpy()
        # Sums up to the end of each text.
        sums, before = np.zeros(len(ends)), 0.0
        for part in _slices(len(which)):
            run = np.cumsum(np.concatenate([[before], loss[which[part]]]))
            chosen = slice(*np.searchsorted(ends, [part.start, part.stop], "right"))
            sums[chosen] = run[ends[chosen] - part.start]
            before = run[-1]
        with np.errstate(invalid="ignore"):
            means.append(np.diff(sums, prepend=0.0) / sizes)
    pa.default_memory_pool().release_unused()
    columns = [pa.array(m, pa.float64(), mask=sizes == 0) for m in (*means, means[0] - means[1])]
    return pa.table([pa.chunked_array([c.flatten() for c in texts.column("ids").chunks], texts.schema.field("ids").type.value_type), pa.array(sizes), *columns], names=["id", "n_tokens", "ce_target", "ce_background", "score"])


def scores(docs: DataFrame, good: DataFrame, text: str = "text", doc_id: str = "doc_id", portion: int = PORTION) -> DataFrame:
    """``id, n_tokens, ce_target, ce_background, score`` of each row of ``docs``; ``good`` lists identifiers (``id``).

    ``n_tokens`` is the number of characters in lower case. A null or empty text has none, and null
    cross-entropies and score. Repeated rows count each time. Without good documents the
    target model knows nothing and is the same for every text. An empty table gives an empty table. Other columns are not
    read. Every n-gram of every whole text counts, of any script.
    """
    spark = docs.sparkSession
    marks = written(good.where("id is not null").select("id").distinct().withColumn("good", F.lit(True)), "target-documents")
    lower: Column = F.lower(F.coalesce(F.col(text), F.lit("")))
    given = docs.select(F.col(doc_id).alias("id"), lower.alias("text")).join(small_side(marks), "id", "left")
    given = given.select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    id_type = given.schema["id"].dataType.simpleString()
    ddl = _BLOCK.format(id=id_type)
    blocks = written(given.mapInArrow(_blocks(_arrow_schema(ddl), portion), ddl), "gram-blocks")

    rows = blocks.where("gram is not null")
    counts = written(rows.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "gram-counts")
    losses = rows.select("gram", "block", "place").join(models(counts), "gram")
    losses = losses.select(F.col("block").alias("owner"), "place", "loss_target", "loss_background")
    texts = blocks.where("gram is null").select("block", "ids", "sizes", "texts")
    # A group is one block.
    return texts.groupBy("block").cogroup(losses.groupBy("owner")).applyInArrow(
        _scores, f"id {id_type}, n_tokens bigint, ce_target double, ce_background double, score double"
    )


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents labelled as of good quality are the target."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return scores(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")
