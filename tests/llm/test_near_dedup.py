"""Near-duplicates against all pairs of a small corpus."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillmap.llm import near_dedup as nd
from quillmap.llm.components import components
from quillmap.llm.shingles import shingle_sets


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= size:
        return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    named = {}
    for i, (k, _) in enumerate(rows):
        named.setdefault(root(i), []).append(k)
    return sorted((k, len(sets[i]), min(named[root(i)])) for i, (k, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.7:
            base = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 30, 60, 120]))))
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size):
    rows = corpus(size, 250) + [(9001, None), (9002, ""), (9003, " \t "), (9004, "One"), (9005, "one"), (9006, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = nd.near_duplicates(df, size=size).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == brute(rows, size)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_no_link_within_a_bucket_is_lost(spark):
    """Copies of one text at all distances: centres alone do not reach them."""
    rnd = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 14)):
            words[rnd.randrange(100)] = f"x{rnd.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df, size=2).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (7, "A B C D E F"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("near_hash", F.lit(1)).withColumn("node", F.lit(2))
    found = nd.near_duplicates(df).collect()
    assert sorted(((r.id, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (7, 5, False), (8, 8, True)], key=str)
    stay = nd.without_near_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id, r.near_hash) for r in stay.collect() if r.doc_id) == [(5, 1), (8, 1)]
    assert [r.text for r in stay.collect() if r.doc_id is None] == ["q r s t u"]


def test_one_row_of_each_component_stays(spark):
    words = [f"w{i}" for i in range(40)]
    near = [" ".join([*words[:k], "x", *words[k + 1:]]) for k in (0, 39)]
    rows = [(None, near[0]), (None, near[1]), (None, near[1]), (3, "a b c d e f"), (3, "A b c d e f"), (4, "a b c d e f"), (9, None), (9, ""), (9, "")]
    stay = nd.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in stay) == ["3", "9", "9", "9", "None"]


def test_copies_under_one_identifier_meet_once(spark, monkeypatch):
    """Two near texts, each 400 times: one pair is confirmed on one set each."""
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([f"x{k}", *words])) for k in (1, 2) for _ in range(400)]
    seen = []
    confirmed = nd._confirmed
    monkeypatch.setattr(nd, "_confirmed", lambda pairs, sets: seen.append(sets.count()) or confirmed(pairs, sets))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 800 and {r.component_id for r in got} == {1} and set(seen) == {2}


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (100, 300), (300, 400), (7, 7)]
    got = components(spark.createDataFrame(chain, "u long, v long")).collect()
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100, 400: 100}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_shingle_hashes_do_not_depend_on_neighbours():
    texts = [b"a b c d", b"", b"x", b"a b c d", b"A  b\tC\nd", "é ñ".encode(), b"y" * (3 << 20) + b" z"]
    sets = list(shingle_sets(texts, 2))
    assert [len(s) for s in sets] == [3, 0, 1, 3, 3, 1, 1]
    assert (sets[0] == sets[3]).all() and (sets[0] == sets[4]).all()
    assert (next(shingle_sets([texts[6]], 2)) == sets[6]).all()
