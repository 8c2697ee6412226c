"""Bit packing: widths, random access, and files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm import bitpack as bp
from quillmap.llm.tokens import byte_bpe_ids

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 5, 12, 16, 17, 31, 32])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    documents = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5000, 3, 9000, 0, 77)]
    system, name = fs.LocalFileSystem(), str(tmp_path / "ids")
    with system.open_output_stream(name) as stream:
        writer = bp.Writer(stream, bits)
        for ids in documents:
            writer.add(ids)
        writer.close()
    with system.open_input_file(name) as stream:
        reader = bp.Reader(stream)
        for i in (4, 0, 6, 2, 1, 5, 3):
            assert (reader.document(i) == documents[i]).all() and len(reader.document(i)) == len(documents[i])
        flat = np.concatenate(documents)
        for start, end in [(0, 0), (4095, 4097), (5000, len(flat)), (1, 2)]:
            assert (reader.range(start, end) == flat[start:end]).all()


def test_widths():
    assert [bp.bits_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_ids_are_those_of_the_library():
    texts = ["", "a  b\n\n c  ", "don't 12 345!", "ñandú é ü", "日本 é", "x<|endoftext|>y", "    z", "tab\t\tend ", " ", "Ÿ¿½²ªº"]
    library = Tokenizer.from_file(JSON)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    fast = byte_bpe_ids(texts, JSON, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [x.tolist() for x in fast] == want
    assert [x.tolist() for x in byte_bpe_ids(texts, JSON, None, None)] == want


def test_files_of_awkward_rows(spark, tmp_path):
    rows = [(4, "four"), (1, None), (2, ""), (None, "none"), (3, "long " * 50_000), (2, ""), (9, "nine nine"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("part", F.lit(1)).withColumn("at", F.lit(2))
    index = bp.write_ids(df, str(tmp_path / "ids"), bp.byte_bpe(), 2, 17)
    got = bp.read_ids(index, str(tmp_path / "ids")).orderBy("start").collect()
    library = Tokenizer.from_file(JSON)
    want = {}
    for k, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(k, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.id for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_empty_table(spark, tmp_path):
    index = bp.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), bp.byte_bpe(), 2, 16)
    assert bp.read_ids(index, str(tmp_path / "e")).collect() == []
