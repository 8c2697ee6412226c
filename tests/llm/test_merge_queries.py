"""Recursive merge queries give the ids of the tiktoken library, and decode to the text's bytes."""

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillmap.llm import merge_queries as mq
from quillmap.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "...", "é", "ß", "中", "文字", "🙂", "́", "\x00",
          "\xa0", " ", "<|endoftext|>", "x" * 30, "ab" * 40, "привет", "한국"]


def library(path=PATH):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=mq.read_ranks(path), special_tokens={})


def digests(ids):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.fixture(scope="module")
def merger():
    return mq.Merger(PATH, PATTERN)


def test_random_texts(merger):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n\n \n"]
    enc = library()
    for text, (n, ids_digest, text_digest, ids, decoded) in zip(texts, merger.results(texts, full=True)):
        want = enc.encode_ordinary(text)
        assert (ids, decoded) == (want, text.encode())
        assert (n, ids_digest) == digests(want) and text_digest == hashlib.sha256(text.encode()).hexdigest()


def test_unbroken_words(merger):
    rnd = random.Random(6)
    texts = ["a" * 100_001, "ab" * 20_000, "".join(rnd.choice("abcdefgh") for _ in range(5000)), "中文" * 3000, "=" * 3001, " " * 5000]
    enc = library()
    assert [r[3] for r in merger.results(texts, full=True)] == [enc.encode_ordinary(t) for t in texts]


def test_portions_and_forgetting(monkeypatch):
    monkeypatch.setattr(mq, "PORTION", 7)
    monkeypatch.setattr(mq, "REMEMBERED", 10)
    monkeypatch.setattr(mq, "AT_ONCE", 3)
    merger, enc = mq.Merger(PATH, PATTERN), library()
    texts = ["one two three four five six seven", "", "one two three four five six seven eight nine ten", "x", "", "a b c d e f g h i j k l m n o p"]
    got = merger.results(texts, full=True)
    assert [r[3] for r in got] == [enc.encode_ordinary(t) for t in texts]
    assert [r[:2] for r in got] == [digests(enc.encode_ordinary(t)) for t in texts]


def test_ranks_in_any_order(tmp_path):
    """Where a merge can lead to a pair of lower rank, pairs go one at a time."""
    tokens = [bytes([i]) for i in range(256)] + [b"cab", b"abab", b"ab", b"ca", b"ba", b"aba", b"bb", b"cabab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    merger = mq.Merger(str(path), PATTERN)
    assert "in_word = 1" in merger.merge_long
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 150))) for _ in range(150)]
    enc = library(str(path))
    assert [r[3] for r in merger.results(texts, full=True)] == [enc.encode_ordinary(t) for t in texts]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello World"), (3, "Hello World"), (None, "x y z"), (4, "some words " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ids", F.lit(0)).withColumn("n_tokens", F.lit(1))
    enc = library()

    def want(k, t):
        ids = enc.encode_ordinary(t or "")
        return (k, *digests(ids), hashlib.sha256((t or "").encode()).hexdigest(), ids, (t or "").encode())

    got = [(*r[:5], bytes(r.decoded)) for r in mq.encode_decode(df, PATH, PATTERN, full=True).collect()]
    assert sorted(got, key=str) == sorted((want(*r) for r in rows), key=str)
    few = mq.encode_decode(df, PATH, PATTERN)
    assert few.columns == ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, few.collect()), key=str) == sorted((want(*r)[:4] for r in rows), key=str)
    assert mq.encode_decode(df.limit(0), PATH, PATTERN).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")
def test_query(spark):
    enc = library()
    want = []
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        text = r.text or ""
        want.append((r.doc_id, *digests(enc.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest()))
    df = QUERIES["op11_byte_bpe"](spark, SF_DIR)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
