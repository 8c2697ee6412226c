"""Tree concatenation gives the library's ids, wherever the cuts fall."""

import hashlib
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmap.llm import bpe
from quillmap.llm.merge_queries import last_pair
from quillmap.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
PIECES = ["a", "b", "é", "é", "'", "'s", "'re", " ", "  ", "\n", "!", "!!!", "1", "23", "<|endoftext|>", "<|endof", "text|>",
          "ß", "İ", "Σ", "x" * 20, "the", "̣́", "中", "한", "ᄀ", "ᅡ", "🙂", " ", "가"]


@pytest.mark.parametrize("blanks", [True, False])
def test_cuts_anywhere(monkeypatch, blanks):
    codec = bpe.Codec(PATH)
    rnd = random.Random(blanks)
    for _ in range(300):
        pool = rnd.sample(PIECES, rnd.randint(1, len(PIECES)))
        pool = [p for p in pool if blanks or not p.isspace()] or ["q"]
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 300)))
        monkeypatch.setattr(bpe, "REACH", rnd.choice([4, 16, 64]))
        want = codec.library.encode(text, add_special_tokens=False).ids
        got = codec.encode(["", text, "short"], leaf=rnd.choice([7, 16, 50]))[1]
        assert got == want
        assert codec.result(got, True)[3:] == [want, codec.library.decode(want, skip_special_tokens=False)]


LATIN = ["a", "B", "the", "é", "É", "ß", "Ÿ", "ŉ", "ſ", "ĳ", "'s", "'S", "'Re", " ", "  ", "\n", "!", "?!", "1", "23", "x" * 20, "œ", "½", "-", "<", "|"]


def test_common_texts_by_ranks():
    codec = bpe.Codec(PATH)
    assert codec.ranked is not None
    rnd = random.Random(4)
    for _ in range(1500):
        pool = rnd.sample(LATIN, rnd.randint(1, len(LATIN)))
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 200)))
        want = codec.library.encode(text, add_special_tokens=False).ids
        assert codec.encode([text], leaf=rnd.choice([9, 40, 4096]))[0] == want, text
    # Each token is what its own bytes are merged to, in the same last step.
    ranks = codec.ranked._mergeable_ranks
    byte = {i: t for t, i in ranks.items()}
    pairs = {i: last_pair(t, ranks) for t, i in ranks.items() if i >= 512 and i < len(codec.token)}
    assert all(p is not None and p[0] + p[1] == byte[i] and max(ranks[p[0]], ranks[p[1]]) < i for i, p in pairs.items() if ranks[p[0]] < len(codec.token) and ranks[p[1]] < len(codec.token))


def test_one_long_stretch_without_a_break():
    codec = bpe.Codec(PATH)
    rnd = random.Random(2)
    for text in ("a" * 30_000, "".join(rnd.choice("abcdefgh") for _ in range(40_000)), "ab" * 20_000):
        assert codec.encode([text], leaf=1000)[0] == codec.library.encode(text, add_special_tokens=False).ids


def test_rows_short_and_spread(spark):
    rows = [(1, None), (2, ""), (3, "Hello World"), (3, "Hello World"), (None, "x y z"), (4, "some words " * 3000), (4, "some words " * 3000), (None, "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("hash", F.lit(0)).withColumn("leaf", F.lit(1))
    library = bpe.Codec(PATH).library

    def want(k, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (k, len(ids), digest(" ".join(map(str, ids))), digest(text), ids, text)

    got = bpe.encode_decode(df, PATH, full=True, leaf=400, spread=2000).collect()
    assert sorted(map(tuple, got), key=str) == sorted((want(*r) for r in rows), key=str)
    few = bpe.encode_decode(df, PATH).collect()
    assert sorted(map(tuple, few), key=str) == sorted((want(*r)[:4] for r in rows), key=str)
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []


def test_vocabulary_over_blanks_is_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")
def test_query(spark):
    library = bpe.Codec(PATH).library
    want = []
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    df = QUERIES["op3_bpe"](spark, SF_DIR)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
