"""WARC archives with a two-level capture index.

Captures are sorted by their reversed-host key (``urlkey``), so each archive and its
index cover one range of keys. The first level of the index are blocks of sorted lines,
compressed one by one; the second is a sparse directory that holds the first key,
offset and length of each block. A lookup searches the directory by bisection, reads one
block by its range, finds the line in it, and reads one record by its range.

Per range two files are written, ``<name>.warc.gz`` (one gzip member per record) and
``<name>.cdx`` (the blocks, then the directory, then its length). Records are written in the order of
the index, so lookups in key order read both files front to back. An index line holds key,
capture number, offset and length of the record.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.bitpack import open_folder
from quillmap.llm.common import query, small_side, table, written
from quillmap.plans.storage import fresh_folder

#: Index lines of a block.
BLOCK_LINES = 512

#: Payloads of fewer bytes are stored in full each time.
LEAST_REVISIT = 1000

#: The date of all records: the tables have no capture time.
DATE = "2024-01-01T00:00:00Z"

_PREFIX = "urn:capture:"
_END = b"\r\n"

Batches = Iterator[pa.RecordBatch]


def url_key(url: Column) -> Column:
    """Host parts in reverse, joined by commas, then the rest: ``com,example)/path?query``.

    In lower case, without scheme, user, port and a leading ``www``. A null URL has an empty key.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(plain, r"^[^/?#]*", 0)
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"^www[0-9]*\.", "")
    rest = F.substring(plain, F.length(host) + 1, F.length(plain))
    reverse = F.array_join(F.reverse(F.split(name, r"\.")), ",")
    return F.when(plain == "", F.lit("")).otherwise(F.concat(reverse, F.lit(")"), rest))


def _record(kind: str, number: str, url: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP header of the full payload and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if kind == "revisit" else http + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{_PREFIX}{number}>", "WARC-Date": DATE,
        "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<{_PREFIX}{refers_to}>"
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head.items()), b"Content-Length: %d" % len(block)]
    return _END.join(lines) + _END * 2 + block + _END * 2


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message, and the payload that the record holds."""
    head, _, rest = data.partition(_END * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END * 2)
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _one_line(url: str | None) -> str:
    """A header holds one line: other characters are escaped as in a URL."""
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")


def _archiver(folder: str) -> Callable[[Batches], Batches]:
    def write(batches: Batches) -> Batches:
        # Each attempt writes files of its own; only those of finished tasks get into the list of files.
        name, archive, index = uuid.uuid4().hex, None, None
        lines, directory, offset, at, last = [], [], 0, 0, None
        system, path = open_folder(folder)

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            index.write(block)
            directory.append([lines[0][:2], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            if archive is None:
                system.create_dir(path, recursive=True)
                archive = system.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                index = system.open_output_stream(f"{path}/{name}.cdx", compression=None)
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                payload = row["html"].encode()
                record = _record(
                    "response" if row["refers_to"] is None else "revisit", row["number"], _one_line(row["url"]),
                    row["digest"], payload, len(payload), row["refers_to"],
                )
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                archive.write(member)
                lines.append([row["urlkey"], row["number"], offset, len(member)])
                offset, last = offset + len(member), [row["urlkey"], row["number"]]
                if len(lines) == BLOCK_LINES:
                    flush()
        if archive is None:
            return
        if lines:
            flush()
        listed = zlib.compress(json.dumps(directory).encode())
        index.write(listed + struct.pack("<Q", len(listed)))
        archive.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [json.dumps(directory[0][0])], "last": [json.dumps(last)]})

    return write


class CaptureIndex:
    """Lookups in one range: its archive, blocks and directory."""

    def __init__(self, folder: str, name: str) -> None:
        system, path = open_folder(folder)
        self.archive = system.open_input_file(f"{path}/{name}.warc.gz")
        self.index = system.open_input_file(f"{path}/{name}.cdx")
        size = self.index.size()
        (length,) = struct.unpack("<Q", self.index.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.index.read_at(length, size - 8 - length)))
        self.keys = [d[0] for d in self.directory]
        self.block: tuple[int, list] = (-1, [])

    def find(self, key: str, number: str) -> tuple[int, int] | None:
        """Offset and length of the record of a capture, or None."""
        at = bisect_right(self.keys, [key, number]) - 1
        if at < 0:
            return None
        if self.block[0] != at:
            _, offset, length = self.directory[at]
            lines = zlib.decompress(self.index.read_at(length, offset)).decode().split("\n")
            self.block = at, [json.loads(x) for x in lines]
        lines = self.block[1]
        low = bisect_right(lines, [key, number], key=lambda x: x[:2]) - 1
        return tuple(lines[low][2:]) if low >= 0 and lines[low][:2] == [key, number] else None

    def read(self, key: str, number: str) -> tuple[dict[str, str], dict[str, str], bytes] | None:
        place = self.find(key, number)
        return place and parse_record(zlib.decompress(self.archive.read_at(place[1], place[0]), 31))

    def close(self) -> None:
        self.archive.close()
        self.index.close()


def _reader(folder: str, files: list[tuple[list[str], str]]) -> Callable[[Batches], Batches]:
    starts, names = [f[0] for f in files], [f[1] for f in files]

    def read(batches: Batches) -> Batches:
        opened: tuple[int, CaptureIndex | None] = (-1, None)
        for batch in batches:
            rows = []
            for key, number in zip(batch.column("urlkey").to_pylist(), batch.column("number").to_pylist()):
                at = bisect_right(starts, [key, number]) - 1
                if at != opened[0]:
                    if opened[1]:
                        opened[1].close()
                    opened = at, CaptureIndex(folder, names[at])
                fields, http, payload = opened[1].read(key, number)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                refers = fields.get("WARC-Refers-To")
                rows.append((int(http["Content-Length"]), digest, kind, refers and _identifier(refers)))
            types = [pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *columns],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return read


def _identifier(record_id: str) -> str:
    """The page's identifier in a record's: what stands before the mark of its content."""
    return record_id[1:-1].removeprefix(_PREFIX).rpartition(".")[0]


def write_archives(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Archives and index of ``pages`` (``page_id, url, html``) below ``folder``.

    Returns written tables: the files with the range of each, and ``page_id, urlkey, number`` of
    the captures. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
    largest identifier is a response (null is the least), others revisit it. Null html is an empty
    payload. Rows with the same identifier and html are one capture with one type.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    captures = pages.select(
        "page_id", url_key(F.col("url")).alias("urlkey"), "url", html.alias("html"),
        F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("."), F.hex(F.xxhash64(html))).alias("number"),
        F.octet_length(html).alias("bytes"), F.sha1(html.cast("binary")).alias("digest"),
        F.sha2(html.cast("binary"), 256).alias("content"),
    )
    large = captures.where(F.col("bytes") >= LEAST_REVISIT)
    groups = large.groupBy("content").agg(F.max(F.struct("page_id", "number")).alias("kept"), F.count(F.lit(1)).alias("captures"))
    groups = written(groups.where("captures > 1").select("content", "kept"), "payload-groups")
    marked = captures.join(small_side(groups), "content", "left")
    refers_to = F.when(F.col("kept.number") != F.col("number"), F.col("kept.number"))
    marked = marked.select("page_id", "urlkey", "url", "html", "number", "digest", refers_to.alias("refers_to"))
    keys = written(captures.select("page_id", "urlkey", "number"), "captures")
    ranged = marked.drop("page_id").repartitionByRange("urlkey", "number").sortWithinPartitions("urlkey", "number")
    files = ranged.mapInArrow(_archiver(folder), "name string, first string, last string")
    return written(files, "archive-files"), keys


def read_archives(files: DataFrame, captures: DataFrame, folder: str) -> DataFrame:
    """Look every capture up and read its record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    The list of files, one per range of the sort, goes to every task.
    """
    listed = sorted((json.loads(f.first), f.name) for f in files.select("first", "name").collect())
    id_type = captures.schema["page_id"].dataType.simpleString()
    ordered = captures.repartitionByRange("urlkey", "number").sortWithinPartitions("urlkey", "number")
    found = ordered.mapInArrow(
        _reader(folder, listed),
        f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to string",
    )
    return found.withColumn("refers_to", F.col("refers_to").cast(id_type))


ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= {LEAST_REVISIT} GROUP BY h)
    SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
           CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN m <> page_id THEN m END AS refers_to
    FROM p LEFT JOIN g ON g.h = p.h"""


@query("op5_warc", ORACLE)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "archives")
    files, captures = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, captures, folder)
