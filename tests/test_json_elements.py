"""JSON documents as element rows, against Python's reader, whatever the chunks."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.operators import validate
from quillmap.sources import json_elements as je
from quillmap.sources.documents import read_tasks


def value(rnd, depth=0):
    k = rnd.random()
    if depth > 3 or k < 0.35:
        return rnd.choice([None, True, 1, -2.5, "x", 'q"\\', "[{,", "é🙂", "", 10**20])
    if k < 0.65:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["a", "b", 'c"', "d,[", "é"]) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


def mangled(rnd, text):
    i, k = rnd.randrange(len(text)), rnd.random()
    return text[:i] + (rnd.choice('{}[],:"\\ x') if k < 0.6 else "") + text[i + (k > 0.3):] if rnd.random() < 0.4 else text


def elements(v, path=()):
    if isinstance(v, list):
        return [(path, i, json.dumps(e)) for i, e in enumerate(v)]
    return [x for k, c in v.items() for x in elements(c, (*path, k))] if isinstance(v, dict) else []


def parsed(text):
    try:
        return json.loads(text)
    except ValueError:
        return ValueError


@pytest.mark.parametrize("size", [1, 3, 40, 1 << 20])
def test_any_chunks(spark, size):
    rnd = random.Random(size)
    texts = [mangled(rnd, json.dumps(value(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))) for _ in range(300)]
    texts += ["", " ", "{} x", "[1,]", "[,1]", "[ ]", '{"a":[1],"a":[2,3]}', '{"a":[1],"a":[x]}', "[1:2]", '{"a":1}],[{"b":2}', "[" * 200 + "]" * 200, "[" * 200 + "}" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "repo int, value string").repartition(4)
    found = je.read_json(df, size=size)
    kinds = {r.repo: r.kind for r in found.heads.collect()}
    got = {}
    for r in found.elements.collect():
        got.setdefault(r.repo, []).append((tuple(r.path), r.at, json.dumps(json.loads(r.element))))
    for i, text in enumerate(texts):
        want = parsed(text)
        if want is ValueError:
            assert kinds[i] is None and i not in got
        else:
            assert kinds[i] is not None and sorted(got.get(i, [])) == sorted(elements(want))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (None, "[1]"), (2, "[2]"), (2, "[2]")], "repo int, value string").withColumn("doc", F.lit("x"))
    found = je.read_json(df)
    assert sorted((r.repo, r.element) for r in found.elements.where("repo is not null").collect()) == [(2, "2"), (2, "2")]
    assert found.heads.count() == 4 and found.heads.where("kind is null").count() == 1
    assert je.read_json(df.limit(0)).heads.collect() == [] and je.read_json(df.limit(0)).elements.collect() == []


def snapshot(n, bad=()):
    files = [{"path": f"f{i}.ts", "hash": None if i in bad else f"h{i}", "lang": "ts", "exports": [], "imports": ["x"], "purpose": 'q"\\'} for i in range(n)]
    return json.dumps({"schemaVersion": 1, "generatedAt": "t", "root": ".", "stack": [], "files": files, "routes": [], "components": [], "db": {"postgres": []}, "stats": {}})


def test_large_snapshot(spark):
    """Some 26 MB in one document, of which no row holds more than one file."""
    texts = [("large", snapshot(250_000)), ("bad", snapshot(3000, bad=(7, 2000))), ("cut", snapshot(3000)[:-5])]
    df = spark.createDataFrame(texts, "repo string, value string")
    files = validate.snapshot_files(validate.read_snapshots(df))
    assert files.where("purpose = 'q\"\\\\' and size(imports) = 1").groupBy("repo").count().collect() == [("large", 250_000)]
    assert sorted(tuple(r) for r in validate.snapshot_problems(df).collect()) == [
        ("bad", 0, "files[7].hash must be a string"), ("bad", 1, "files[2000].hash must be a string"), ("cut", 0, validate.MALFORMED)]


def test_versions(spark):
    rest = '"generatedAt":"t","root":".","stack":[],"files":[],"routes":[],"components":[],"db":{},"stats":{}}'
    shown = {"1": None, "1.0": None, "2": "2", '"1"': "1", "null": "null", "true": "true", "{}": "[object Object]", "[1,null,\"a\"]": "1,,a", "[]": ""}
    df = spark.createDataFrame([(k, f'{{"schemaVersion":{k},{rest}') for k in shown] + [("none", "{" + rest)], "repo string, value string")
    got = {r.repo: r.problem for r in validate.snapshot_problems(df).collect()}
    want = {**shown, "none": "undefined"}
    assert got == {k: f"schemaVersion mismatch: expected 1, got {v}" for k, v in want.items() if v is not None}


def test_tasks_are_read_one_by_one(spark):
    task = '{"id":"t-001","title":"a","status":"open"}'
    texts = [(1, f"[{task}, 7]"), (2, f"[{task}"), (3, task), (4, f" [ {task} ] "), (5, f"[{task},]"), (6, None)]
    got = read_tasks(spark.createDataFrame(texts, "repo int, text string")).select("repo", "id", "suited").collect()
    assert sorted(tuple(r) for r in got) == [(1, "t-001", []), (4, "t-001", [])]


def test_many_small_documents(spark):
    """They are dealt out although their bytes are few, and go through a call together, not each in a group of its own."""
    df = spark.createDataFrame([(i, f'[{{"id": "t-{i}"}}]') for i in range(2000)], "repo int, text string").coalesce(1)
    chunks = je.document_chunks(df, "text")
    assert chunks.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(i // 2, i % 2, i % 2 == 0, "", "[" if i % 2 == 0 else "", "]", "") for i in range(5000)]
    names = ["doc", "at", "odd", "closes_out", "opens_out", "closes_in", "opens_in"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    # The last document of the first batch goes on in the second.
    found = list(je._by_document(je._beginnings, je._BEGINNING_FIELDS)(iter([batch.slice(0, 2501), batch.slice(2501)])))
    assert len(found) == 1 and found[0].column("doc").to_pylist() == [r[0] for r in rows]
    assert found[0].column("inside").to_pylist() == [False, True] * 2500 and not any(found[0].column("fits").to_pylist())
    assert sorted(r.id for r in read_tasks(df).collect()) == sorted(f"t-{i}" for i in range(2000))
