"""Decontamination against sliding windows over small texts."""

import random
import re

from pyspark.sql import functions as F

from quillmap.llm import decontamination as dc

ITEMS = "item_id string, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = []
    for k, text in docs:
        w, hit, met = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(size, len(p))
            for s in range(len(p) - n + 1 if p else 0):
                for at in range(len(w) - n + 1):
                    if w[at: at + n] == p[s: s + n]:
                        hit |= set(range(at, at + n))
                        met.add(item)
        out.append((k, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


def outcome(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("term", F.lit(0)).withColumn("pos", F.lit(0))
    found = dc.contamination(df, spark.createDataFrame(items, ITEMS), **more)
    return sorted(((r.doc.id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)


def test_against_sliding_windows(spark):
    rnd = random.Random(4)
    pool = ["a", "B", "the", "x1", "é", "of", "zz"]
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(pool) for _ in range(n))
    items = [(str(i), text(rnd.choice([1, 2, 3, 5, 8]))) for i in range(12)] + [("n", None), ("e", " ... "), ("0", text(4))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)]
    docs += [(None, items[3][1]), (None, None), (1, docs[1][1]), (77, ""), (78, "word " * 30_000 + items[2][1])]
    assert outcome(spark, docs, items, size=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs = [(1, "a b c"), (2, None)]
    assert outcome(spark, docs, [], size=2) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert outcome(spark, [], [("a", "a b")], size=2) == []


def test_proximity(spark):
    items = [("i", "red green blue")]
    docs = [(1, "red green blue"), (2, "red x green blue"), (3, "green red blue"), (4, "red x x x green x x x blue"), (5, "red green")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    windows, _ = dc.test_windows(spark.createDataFrame(items, ITEMS), "text", "item_id", 3)
    index = dc.build_index(df, "text", "doc_id", windows.select(F.explode("terms").alias("term")))
    ids = lambda slop: {r.doc.id for r in dc.matches(index, windows, slop).collect()}
    # The rarest word, blue, fixes the places: in document 4 red is 6 away from its own.
    assert ids(0) == {1} and ids(1) == {1, 2, 3} and ids(5) == {1, 2, 3} and ids(6) == {1, 2, 3, 4}


def test_clean_documents_keep_all_columns(spark):
    docs = [(1, "p q r s"), (2, "p q z"), (2, "p q z"), (3, None), (None, "p q r")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("own"))
    items = spark.createDataFrame([("i", "p q r")], ITEMS)
    stay = dc.clean_documents(df, items)
    assert stay.columns == df.columns
    assert sorted((r.doc_id, r.doc) for r in stay.collect()) == [(2, "own"), (2, "own"), (3, "own")]
