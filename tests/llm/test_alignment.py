"""Alignment of two vocabularies against plain comparisons of byte ranges."""

import hashlib
import os
import random
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm import alignment
from quillmap.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
PIECES = ["a", "token", "ization", " ", "  ", "\n", "é", "中文", "🙂", "ﬁ", "½", "123", "!", "<|endoftext|>", "<s>", "<0x41>", "▁", "\t", "́", "Ω"]


def byte_alphabet():
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and not 0x7F <= b <= 0xA0]
    others = iter(range(256))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in others if b not in shown)}


ALPHABET = byte_alphabet()
TOKENS, SP = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
TOKENS.encode_special_tokens = True


def spans(parts):
    out, at = [], 0
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def brute(text):
    """Ids, linked places and groups of one text."""
    if not text:
        return [], [], [], []
    ids_a, ids_b = TOKENS.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    bytes_a = [bytes(ALPHABET[c] for c in TOKENS.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [SP.id_to_piece(i)]]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    a, b = spans(bytes_a), spans(bytes_b)
    owner = [j for j, (s, e) in enumerate(b) for _ in range(s, e)]
    links = [(i, j) for i, (s, e) in enumerate(a) for j in sorted(set(owner[s:e]))]
    ends = sorted({e for _, e in a} & {e for _, e in b})
    inside = lambda ids, parts: [[x for x, (_, e) in some] for _, some in groupby(zip(ids, parts), lambda p: bisect_left(ends, p[1][1]))]
    groups = list(zip(inside(ids_a, a), inside(ids_b, b)))
    return ids_a, ids_b, links, groups


def expected(rows):
    found = [(k, brute(t)) for k, t in rows]
    count = Counter(p for _, (a, b, links, _) in found for p in {(a[i], b[j]) for i, j in links})
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for k, (a, b, links, groups) in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        ids = [(a[i], b[j]) for i, j in links]
        out.append((k, len(a), len(b), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if a else "",
                    sum(count[p] == top[p[0]] for p in ids), sum(count[p] for p in ids)))
    return sorted(out, key=str)


def sample(rnd, n):
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 25))) for _ in range(n)]
    return [*texts, "plain words and more plain words", " leading", "trailing ", "x" * 500]


def test_alphabet():
    assert alignment.byte_of_character() == ALPHABET and len(ALPHABET) == 256


def test_lockstep():
    rnd = random.Random(4)
    for _ in range(200):
        ends_a, ends_b, counts, links, at = [], [], [], [], 0
        for _ in range(rnd.randint(0, 5)):
            size = rnd.choice([0, rnd.randint(1, 40)])
            cuts = [sorted({size, *(rnd.randint(1, size) for _ in range(rnd.randint(0, 30)))}) if size else [] for _ in "ab"]
            first_a, first_b = len(ends_a), len(ends_b)
            counts.append(len(cuts[0]))
            a, b = ([(s, e) for s, e in zip([0, *c], c)] for c in cuts)
            links += [(first_a + i, first_b + j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]
            ends_a += [at + e for e in cuts[0]]
            ends_b += [at + e for e in cuts[1]]
            at += size
        both = set(ends_a) & set(ends_b)
        got = alignment.lockstep(np.array(ends_a, int), np.array(ends_b, int), np.array(counts, int), lane=rnd.choice([1, 3, 100]))
        assert sorted(zip(got.link_a.tolist(), got.link_b.tolist())) == sorted(links)
        assert [e in both for e in ends_a] == got.cut_a.tolist() and [e in both for e in ends_b] == got.cut_b.tolist()


@pytest.mark.parametrize(("portion", "ranks"), [(60, None), (6 << 20, public_tokenizers.path("byte_bpe_50k.tiktoken"))])
def test_rows(spark, portion, ranks):
    rows = [*enumerate(sample(random.Random(9), 150)), (7, None), (8, ""), (3, "same text"), (3, "same text"), (None, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("block", F.lit(1)).withColumn("pair", F.lit("x"))
    assert sorted(map(tuple, alignment.alignment_counts(df, A, B, ranks_a=ranks, portion=portion).collect()), key=str) == expected(rows)
    assert alignment.alignment_counts(df.limit(0), A, B).collect() == []
    for r in alignment.alignments(df.where("doc_id is not null and doc_id > 8"), A, B).collect():
        a, b, links, groups = brute(dict(rows)[r.id])
        assert (r.ids_a, r.ids_b, list(zip(r.link_a, r.link_b))) == (a, b, links)
        assert sum(r.cut_a) == sum(r.cut_b) == len(groups)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    df = QUERIES["op12_alignment"](spark, SF_DIR)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == expected(rows)
