"""Token ids in files of fixed-width bit packing.

A file holds the ids of a range of documents, in the order of their identifiers. Each id
takes the least number of bits that the vocabulary needs. Ids are packed in blocks of
``BLOCK_IDS``, so a block begins at a byte and its offset is a multiple of one size; a
reader fetches only the blocks of the ids that it wants and unpacks them with numpy.

File: the blocks, then the first id of each document and the end of the last as 64-bit
numbers, then magic, bits, ids per block, number of ids and of documents. All numbers
are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import query, table, written
from quillmap.llm.tokens import byte_bpe_ids
from quillmap.plans.storage import fresh_folder

BLOCK_IDS = 4096

#: Ids that are read before rows are passed on.
PORTION = 8 << 20
_HEADER = struct.Struct("<8sIIQQ")
_MAGIC = b"TOKBITS1"

Batches = Iterator[pa.RecordBatch]


def bits_for(vocabulary: int) -> int:
    """The least width, in bits, that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    spread = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    return flags.reshape(count, bits) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def block_bytes(bits: int) -> int:
    return BLOCK_IDS * bits // 8


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a shared folder, from a URI or a bare path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Writer:
    """One file, written block by block; at most a block and one document are held."""

    def __init__(self, stream: pa.NativeFile, bits: int) -> None:
        self.stream, self.bits = stream, bits
        self.held: list[np.ndarray] = []
        self.waiting, self.ids = 0, 0
        self.starts: list[int] = []

    def add(self, ids: np.ndarray) -> None:
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            flat = np.concatenate(self.held)
            full = len(flat) // BLOCK_IDS * BLOCK_IDS
            self.stream.write(pack(flat[:full], self.bits))
            self.held, self.waiting = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.waiting:
            self.stream.write(pack(np.concatenate(self.held), self.bits))
        self.stream.write(np.array([*self.starts, self.ids], "<u8").tobytes())
        self.stream.write(_HEADER.pack(_MAGIC, self.bits, BLOCK_IDS, self.ids, len(self.starts)))


class Reader:
    """Random access to one file: ids of any range, or of any document by its place."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream = stream
        size = stream.size()
        magic, self.bits, block, self.ids, self.documents = _HEADER.unpack(stream.read_at(_HEADER.size, size - _HEADER.size))
        if magic != _MAGIC or block != BLOCK_IDS:
            raise ValueError("not a file of packed ids")
        width = 8 * (self.documents + 1)
        self.starts = np.frombuffer(stream.read_at(width, size - _HEADER.size - width), "<u8").astype(np.int64)

    def range(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, -(-end // BLOCK_IDS)
        count = min(last * BLOCK_IDS, self.ids) - first * BLOCK_IDS
        data = self.stream.read_at(-(-count * self.bits // 8), first * block_bytes(self.bits))
        return unpack(data, self.bits, count)[start - first * BLOCK_IDS: end - first * BLOCK_IDS]

    def document(self, at: int) -> np.ndarray:
        return self.range(int(self.starts[at]), int(self.starts[at + 1]))


def _packer(
    folder: str, encode: Callable[[list[str]], list[np.ndarray]], end_id: int, bits: int
) -> Callable[[Batches], Batches]:
    def write(batches: Batches) -> Batches:
        # Each attempt writes a file of its own; only files of finished tasks get into the index.
        name, writer, stream = f"{uuid.uuid4().hex}.bits", None, None
        system, path = open_folder(folder)
        for batch in batches:
            if writer is None:
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}")
                writer = Writer(stream, bits)
            at = len(writer.starts)
            for text in batch.column("text"):
                ids = encode([text.as_py() or ""])[0]
                writer.add(np.append(ids, np.uint32(end_id)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array([name] * len(batch), pa.string()),
                 pa.array(range(at, at + len(batch)), pa.int64())],
                names=["id", "part", "file", "at"],
            )
        if writer is not None:
            writer.close()
            stream.close()

    return write


def _footers(folder: str) -> Callable[[Batches], Batches]:
    def read(batches: Batches) -> Batches:
        system, path = open_folder(folder)
        for batch in batches:
            counts = []
            for file in batch.column("file").to_pylist():
                with system.open_input_file(f"{path}/{file}") as stream:
                    counts.append(Reader(stream).ids)
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(counts, pa.int64())], names=["part", "n_ids"])

    return read


def _unpacker(folder: str) -> Callable[[Batches], Batches]:
    def read(batches: Batches) -> Batches:
        system, path = open_folder(folder)
        for batch in batches:
            files, places = batch.column("file").to_pylist(), batch.column("at").to_pylist()
            first = 0
            while first < len(files):
                with system.open_input_file(f"{path}/{files[first]}") as stream:
                    reader = Reader(stream)
                    last, ids = first, []
                    starts, counts, sums = [], [], []
                    while last < len(files) and files[last] == files[first] and sum(counts) < PORTION:
                        ids = reader.document(places[last])
                        starts.append(int(reader.starts[places[last]]))
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        last += 1
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("part"), *(pa.array(x, pa.int64()) for x in (starts, counts, sums))],
                    names=["id", "part", "local", "n_tokens", "ids_crc32"],
                )
                first = last

    return read


def write_ids(
    docs: DataFrame, folder: str, encode: Callable[[list[str]], list[np.ndarray]], end_id: int, bits: int,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Encode all texts, write the ids below ``folder``, return the index ``id, part, file, at``.

    Documents lie in ascending order of identifier (nulls first; repeated ones in an order
    fixed by their texts) over files in ascending order of ``part``. A null text has the end id
    alone. An empty table writes no file. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    id_type = rows.schema["id"].dataType.simpleString()
    # Texts are encoded after the exchange: finding its ranges reads the input once more.
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    placed = ordered.select("id", "text", F.spark_partition_id().alias("part"))
    files = placed.mapInArrow(
        _packer(folder, encode, end_id, bits), f"id {id_type}, part int, file string, at bigint"
    )
    return written(files, "packed-index")


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of each document, all from the files of ``folder``."""
    id_type = index.schema["id"].dataType.simpleString()
    files = index.groupBy("part", "file").agg(F.count(F.lit(1)).alias("documents")).select("part", "file")
    counts = files.mapInArrow(_footers(folder), "part int, n_ids bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, that is per range of the sort.
    starts = counts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    local = index.mapInArrow(
        _unpacker(folder), f"id {id_type}, part int, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    out = local.join(F.broadcast(starts), "part")
    return out.select("id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


#: The end of a document.
END_ID = 2


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of batches of texts with a public byte-level vocabulary."""
    json_path, ranks, pattern = public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN
    return lambda texts: byte_bpe_ids(texts, json_path, ranks, pattern)


@query("op9_token_output")
def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the 50,257 ids of the byte-level vocabulary: 16 bits an id."""
    folder = fresh_folder(spark, "packed-ids")
    index = write_ids(table(spark, sf_dir, "documents"), folder, byte_bpe(), END_ID, bits_for(50_257))
    return read_ids(index, folder).withColumnRenamed("id", "doc_id")
