"""Every query of the subpackage on the smallest tables: against its SQL, or a brute-force version."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quillmap.llm.queries import ORACLES, QUERIES

from test_decontamination import brute as decontaminated
from test_near_dedup import brute as near_components

SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(row[i]) for i in at) for row in want.fetchall()) and got


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


def test_pipeline(spark, duck):
    rows = duck.sql("SELECT doc_id, text, lang FROM documents").fetchall()
    kept = [(k, t) for k, t, _ in rows if any(c.isalpha() for c in t or "")]
    last = {}
    for k, t in kept:
        last[t] = max(k, last.get(t, k))
    kept = [(k, t) for k, t in kept if last[t] == k]
    named = {k: c for k, _, c in near_components(kept, 5)}
    kept = [(k, t) for k, t in kept if named[k] == k]
    hits = {k: n for k, _, n, _ in decontaminated(kept, duck.sql("SELECT item_id, text FROM benchmark").fetchall(), 10)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, t in kept:
        if not hits[k]:
            ids = library.encode(t, add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((k, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == sorted(want) and 0 < len(got) < len(rows)


AWKWARD = [
    (1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (None, "one two three four five six seven", None),
    (None, "eight nine ten eleven twelve thirteen", "de"), (2, None, "en"), (3, "", None), (4, " 123 !", "de"), (5, "x" * 30_000, "en"),
    (6, "the benchmark passage of ten words is in this text here and more follows after it", "en"), (7, "One Two three four five six seven", "en"),
]


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_pipeline_on_awkward_rows(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string"
    clashing = ["near_key", "near_hash", "at_file", "at_row", "language", "hash", "id", "node", "item_id", "n_words"]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for name in clashing:
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [("b", "benchmark passage of ten words is in this text here"), ("c", None), ("d", "")] if rows else []
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(sorted(str(r.doc_id) for r in docs.collect()))
    if rows:
        assert seen == [["1", "1", "5", "6", "7", "None", "None"], ["1", "5", "6", "7", "None"], ["1", "5", "6", "None"], ["1", "5", "None"]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == (seen[-1] if rows else [])
