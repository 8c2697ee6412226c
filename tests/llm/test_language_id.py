"""Language identification: the network against plain loops, and accuracy on held-out text."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import language_id as li

SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")


def slow(network, text):
    """Window by window and filter by filter."""
    data = text.encode()
    total = np.zeros(len(network.labels))
    for at in range(0, len(data), li.WINDOW):
        part = data[at: at + li.WINDOW]
        window = part.ljust(li.WINDOW, b"\0")
        pooled = []
        for w in li.WIDTHS:
            for f in range(li.FILTERS):
                sums = [sum(network.filters[w][j][window[p + j]][f] for j in range(w)) for p in range(li._POSITIONS)]
                pooled.append(max(0, max(sums)))
        z = np.array(pooled) @ network.weights + network.bias
        e = np.exp(z - z.max())
        total += e / e.sum() * len(part)
    return total / len(data)


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    texts = [b"abcab cabba " * 30, b"xyzzy zyxyx " * 30]
    windows = np.array([list(t[o: o + li.WINDOW]) for t in texts for o in rng.integers(0, 90, 40)], np.uint8)
    return li.fit(windows, np.repeat([0, 1], 40), ["ab", "xy"])


def test_against_plain_loops(network):
    texts = ["abc cab", "zyx " * 100, "a", "ñandú xyz", "ab" * 300 + "zyx"]
    names, scores = network.predict(texts)
    for text, name, score in zip(texts, names, scores):
        want = slow(network, text)
        assert name == network.labels[int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-4)
    assert network.predict(["abcab cabba", "zyxyx xyz"])[0] == ["ab", "xy"]


def test_texts_without_letters(network):
    names, scores = network.predict([None, "", " 12 + !", "½ _", "b"])
    assert names[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and names[4] in network.labels


def test_awkward_rows_and_clashing_columns(spark, network):
    rows = [(1, None), (None, ""), (2, "abcab " * 60_000), (2, "zyxyx"), (2, "zyxyx"), (3, "77")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("own"))
    got = df.withColumn("found", li.predicted(network, F.col("text"))).collect()
    assert {(r.doc_id, r.found["lang"]) for r in got} == {(1, "und"), (None, "und"), (2, "ab"), (2, "xy"), (3, "und")}
    assert len(got) == 6 and all(r.language == "own" for r in got)


def test_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "1", None)], "doc_id long, text string, lang string")
    none = li.train(df)
    assert none.labels == [] and none.predict(["abc"]) == (["und"], [0.0])
    assert [r.doc_id for r in li.accepted_documents(df).collect()] == [1]
    assert li.train(df.limit(0)).labels == []


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("sample tables not found")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = li.op1_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held) > 0
    stay = li.accepted_documents(docs)
    assert stay.columns == docs.columns and stay.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
