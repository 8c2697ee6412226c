"""Cross-entropy difference against counts in dictionaries."""

import math
import os
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.llm import lm_scoring as lm
from quillmap.llm.common import written
from quillmap.llm.queries import QUERIES

SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
SCRIPTS = "abcdefghijklmnopqrstuvwxyz 0123456789.,ABCÉéßабвгджзиклмнопαβγδεζηθ中文字語한국어日本🙂🙃́אבגדهوي\t\n\x00"
GOOD = [(1,), (2,), (2,), (None,), (77,)]


def grams(text):
    padded = lm._START * (lm.ORDER - 1) + text.lower()
    return [padded[i: i + lm.ORDER] for i in range(len(text.lower()))]


def losses(texts, every):
    counts = [Counter(g[lm.ORDER - n:] for t in texts for g in grams(t)) for n in range(lm.ORDER + 1)]
    contexts = [Counter() for _ in range(lm.ORDER + 1)]
    for n in range(1, lm.ORDER + 1):
        for g, c in counts[n].items():
            contexts[n][g[:-1]] += c
    size = len({c for t in every for c in t.lower()})

    def loss(g):
        p = 1 / size
        for n in range(1, lm.ORDER + 1):
            s = g[lm.ORDER - n:]
            p = (counts[n][s] + lm.PRIOR * p) / (contexts[n][s[:-1]] + lm.PRIOR)
        return -math.log2(p)

    return loss


def expected(rows, good):
    texts = [t or "" for _, t in rows]
    models = losses([t or "" for k, t in rows if k in good], texts), losses(texts, texts)
    out = []
    for k, t in rows:
        g = grams(t or "")
        means = [sum(map(f, g)) / len(g) if g else None for f in models]
        out.append((k, len(g), *means, means[0] - means[1] if g else None))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], str(r[2] and round(r[2], 6)))) for x in (got, want))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == (pytest.approx(b[2:], abs=1e-9) if b[2] is not None else b[2:])


@pytest.mark.parametrize("portion", [50, 8 << 20])
def test_against_dictionaries(spark, portion):
    rnd = random.Random(portion)
    rows = [(i, "".join(rnd.choice(SCRIPTS) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows += [(1, "The cat sat."), (3, "zzz!! ## zzz"), (3, "zzz!! ## zzz"), (4, None), (5, ""), (None, "Né cat"), (6, "cat " * 3000), (7, "\x00"), (8, "a\x00\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("good", F.lit(0)).withColumn("target", F.lit(1))
    got = lm.scores(df, spark.createDataFrame(GOOD, "id long"), portion=portion)
    assert got.columns == ["id", "n_tokens", "ce_target", "ce_background", "score"]
    same([tuple(r) for r in got.collect()], expected(rows, {1, 2, 77}))


def test_very_many_characters():
    """More than one number can hold for an n-gram."""
    rnd = random.Random(2)
    texts = ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(9000)), "", "ab"]
    names, which, sizes = lm.grams_of(texts)
    assert [names[i] for i in which] == [g for t in texts for g in grams(t)] and sizes.tolist() == [9000, 0, 2]
    assert len(set(names)) == len(names) and lm.grams_of([])[0] == [] and lm.grams_of(["", ""])[0] == []
    assert lm.grams_of(texts[::-1])[0] == names


def test_without_good_documents(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "other")], "doc_id long, text string")
    rows = lm.scores(df, spark.createDataFrame([], "id long")).collect()
    size = len(set("some textother"))
    assert all(r.ce_target == pytest.approx(math.log2(size)) for r in rows)
    assert lm.scores(df.limit(0), spark.createDataFrame([], "id long")).collect() == []


def test_models_grow_with_the_corpus(spark):
    def size(n):
        rows = [(i, f"word{i} {i * 7919} text") for i in range(n)]
        text = [t for _, t in rows]
        df = spark.createDataFrame([(g, 1, 1) for g in lm.grams_of(text)[0]], "gram string, target long, background long")
        return lm.models(df).count()

    assert size(200) < size(400) < size(800)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()}
    df = QUERIES["op6_lm_scoring"](spark, SF_DIR)
    assert df.columns[0] == "doc_id"
    same([tuple(r) for r in df.collect()], expected(rows, good))


def test_memory_of_a_block():
    """Arrays of a block are bounded by its characters; sorting copies of all n-grams would need twice as much."""
    rnd = random.Random(5)
    text = "".join(rnd.choice("abc é") for _ in range(400_000))
    lm.grams_of(["ab"])  # what is imported late does not count
    tracemalloc.start()
    names, which, sizes = lm.grams_of([text, "x"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [names[i] for i in which[:50]] == grams(text)[:50] and len(which) == sum(sizes) == 400_001
    assert peak < 45 * len(text)


def test_texts_of_a_block_are_stored_compressed(spark, monkeypatch):
    """The stored and shuffled texts take a fraction of their own bytes, and come back whole."""
    kept = {}
    monkeypatch.setattr(lm, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(words, k=40))) for i in range(400)] + [(400, "é" * 9 + "🙂"), (401, ""), (402, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lm.scores(df, spark.createDataFrame(GOOD, "id long"))
    same([tuple(r) for r in got.collect()], expected(rows, {1, 2, 77}))
    blocks = kept["gram-blocks"].where("gram is null").collect()
    texts = [t for b in blocks for t in lm._unpacked(b.texts, b.sizes)]
    assert texts == [(t or "").lower() for _, t in rows] and [k for b in blocks for k in b.ids] == [k for k, _ in rows]
    assert sum(len(b.texts) for b in blocks) < 0.4 * sum(len(t.encode()) for t in texts)


def block_rows(monkeypatch, texts, good, portion):
    """What a task makes of the texts, without Spark."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "texts": pa.binary(), "place": pa.int32(), "gram": pa.string(), "target": pa.int64(), "background": pa.int64()}
    docs = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "good": good})
    return lm._blocks(pa.schema(kinds), portion)(iter([docs]))


@pytest.mark.parametrize("width, rows, portion", [(1, 1, 40), (7, 3, 100), (64, 50, 8 << 20), (1 << 19, 1 << 16, 8 << 20)])
def test_slices_of_a_block(monkeypatch, width, rows, portion):
    """Counts and scores do not depend on where a block is cut to slices."""
    monkeypatch.setattr(lm, "_SLICE", width)
    monkeypatch.setattr(lm, "_ROWS", rows, raising=False)
    rnd = random.Random(width)
    texts = ["", "", "ab"] + ["".join(rnd.choice(SCRIPTS + "\r\n\x85\u2028") for _ in range(rnd.choice([0, 1, 3, 30]))) for _ in range(20)] + ["ab\r\n\r", ""]
    texts = [t.lower() for t in texts]
    good = [i % 3 == 0 for i in range(len(texts))]
    blocks = {}
    for batch in block_rows(monkeypatch, texts, good, portion):
        for r in batch.to_pylist():
            blocks.setdefault(r["block"], []).append(r)
    for whole, *found in blocks.values():
        own = [texts[i] for i in whole["ids"]]
        counts = Counter(g for t in own for g in grams(t))
        assert {r["gram"]: r["background"] for r in found} == counts and len(found) == len(counts)
        wanted = Counter(g for i in whole["ids"] if good[i] for g in grams(texts[i]))
        assert {r["gram"]: r["target"] for r in found if r["target"]} == wanted
        loss = {r["gram"]: rnd.random() for r in found}
        shuffled = rnd.sample(found, len(found))
        held = pa.table({"ids": [whole["ids"]], "sizes": [whole["sizes"]], "texts": pa.array([whole["texts"]], pa.binary())})
        at = pa.array([r["place"] for r in shuffled], pa.int32())
        got = lm._scores(held, pa.table({"place": at, "loss_target": [loss[r["gram"]] for r in shuffled], "loss_background": np.ones(len(at))}))
        for t, r in zip(own, got.to_pylist(), strict=True):
            want = sum(loss[g] for g in grams(t)) / len(t) if t else None
            assert r["n_tokens"] == len(t) and r["ce_target"] == (pytest.approx(want) if t else None)
            assert r["ce_background"] == (pytest.approx(1) if t else None)
    assert sorted(i for whole, *_ in blocks.values() for i in whole["ids"]) == list(range(len(texts)))


def test_memory_of_scoring_a_block(monkeypatch):
    """Losses and sums of all characters at once would need four times as much."""
    monkeypatch.setattr(lm, "_SLICE", 1 << 14)
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("aé🙂", k=2000)) for _ in range(300)]
    n = sum(map(len, texts))
    m = len(lm.grams_of(texts)[0])
    held = pa.table({"ids": [list(range(len(texts)))], "sizes": [[len(t) for t in texts]], "texts": pa.array([pa.compress("".join(texts).encode(), "zstd", asbytes=True)], pa.binary())})
    losses = pa.table({"place": pa.array(range(m), pa.int32()), "loss_target": np.full(m, 3.0), "loss_background": np.ones(m)})
    tracemalloc.start()
    got = lm._scores(held, losses)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("score").to_pylist() == [2.0] * len(texts)
    assert peak < 12 * n


def test_memory_of_many_different_grams(monkeypatch):
    """Rows of n-grams are made some at a time."""
    monkeypatch.setattr(lm, "_SLICE", 1 << 14)
    monkeypatch.setattr(lm, "_ROWS", 1 << 12, raising=False)
    rnd = random.Random(7)
    text = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(300_000))
    made = block_rows(monkeypatch, [text, "x"], [True, False], 8 << 20)
    assert next(made).column("sizes")[0].as_py() == [len(text), 1]
    tracemalloc.start()
    found = sum(len(batch) for batch in made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(set(grams(text))) + 1
    assert peak < 60 * len(text)
