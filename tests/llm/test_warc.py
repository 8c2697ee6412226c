"""WARC: what is written is read back through the index, revisits included."""

import gzip
import hashlib

from pyspark.sql import functions as F

from quillmap.llm import warc

BIG = "<p>same</p>" * 200
ROWS = [
    (1, "http://www.Example.org/a?x=1", BIG), (2, "https://user@example.org:8080/b", BIG), (9, "http://b.example.com/", BIG),
    (3, None, None), (4, "", ""), (5, "http://example.org/short", "<p>short</p>"), (6, "http://example.org/short", "<p>short</p>"),
    (7, "http://example.org/a?x=1", "ñ\r\n\r\n" * 500), (8, "odd url\r\nX-Bad: 1", "x" * 300_000), (None, "http://n.org", "null id" * 200),
    (2, "https://user@example.org:8080/b", BIG),
]


def expected(rows):
    groups = {}
    for k, _, h in rows:
        if len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        keep = max((x for x in groups.get(h, []) if x is not None), default=None)
        revisit = keep is not None and keep != k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.repartition(3).withColumn("number", F.lit("own")).withColumn("digest", F.lit(0))


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    folder = str(tmp_path / "archives")
    files, captures = warc.write_archives(pages(spark, ROWS), folder)
    got = warc.read_archives(files, captures, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)
    for f in files.collect():
        data = gzip.decompress((tmp_path / "archives" / f"{f.name}.warc.gz").read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\r\nX-Bad" not in data


def test_lookups(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/p{i}", f"body {i}") for i in range(1300)]
    folder = str(tmp_path / "archives")
    files, captures = warc.write_archives(pages(spark, rows), folder)
    names = {tuple(r) for r in captures.collect()}
    found = 0
    for f in files.collect():
        index = warc.CaptureIndex(folder, f.name)
        assert len(index.directory) == -(-sum(1 for _ in index_lines(index)) // warc.BLOCK_LINES)
        for page, key, number in names:
            hit = index.read(key, number)
            if hit:
                found += 1
                assert hit[2] == f"body {page}".encode() and hit[0]["WARC-Record-ID"].endswith(f"{number}>")
        assert index.find("", "") is None and index.find("zzz)", "0") is None
        index.close()
    assert found == len(rows)


def index_lines(index):
    for key, *_ in index.directory:
        index.find(*key)
        yield from index.block[1]


def test_url_keys(spark):
    urls = ["http://www.Example.org/a?x=1", "https://u:p@b.example.com:80/", "example.org", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("k"))
    assert [r.k for r in df.collect()] == ["org,example)/a?x=1", "com,example,b)/", "org,example)", "", ""]


def test_empty_table(spark, tmp_path):
    files, captures = warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_archives(files, captures, str(tmp_path / "none")).collect() == []
