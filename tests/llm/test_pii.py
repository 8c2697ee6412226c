"""Personal data: patterns against Python's matcher, disclosure against plain counts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmap.llm import pii

# The base patterns as agreed, without the guards that make them linear.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]


def test_patterns(spark):
    rnd = random.Random(8)
    pool = ["a", "B", ".", "@", "_", "-", "+", "1", "25", "255", "0", "007", " ", "  ", "(", ")", "é", "🙂", "x@y.zz", "1.2.3.4",
            "4111 1111 1111 1111", "+1 202 555 0100", "4111111111111111", "%", "378282246310005", "6011-0009-9013-9424"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    # Plain matching takes quadratic time on these two, which hold nothing.
    bare = ["a" * 200_000, "9" * 200_000]
    texts += [*bare, "1 " * 100_000, "1.2." * 2000, "+1" + "(" * 100_000, "@" * 50_000, "x@" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: [(s.kind, s.start, s.end) for s in r.s] for r in df.select("i", pii.pattern_spans(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [[] if t in bare else brute(t) for t in texts]


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def entity(kind, value):
    return kind + ":" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))


def marked(rows):
    """All terms of all texts by plain counting over documents."""
    texts = [t or "" for _, t in rows]
    spans = {t: brute(t) for t in texts}
    words = {t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(WORD, t)] for t in texts}
    free = {t: [w for w in words[t] if any(c.isalpha() for c in w[2]) and all(e < w[0] or w[1] < s for _, s, e in spans[t])]
            for t in texts if spans[t]}
    entities = {t: {entity(k, t[s:e]) for k, s, e in spans[t]} for t in texts}
    terms = {t: {w[2] for w in free.get(t, [])} for t in texts}
    out = {}
    for t in set(texts):
        found = []
        for start, end, term in free.get(t, []):
            best = -math.inf
            for e in entities[t]:
                with_e, with_t = (sum(x in y[u] for u in texts) for x, y in ((e, entities), (term, {u: {w[2] for w in words[u]} for u in texts})))
                both = sum(e in entities[u] and term in terms[u] for u in texts)
                support = sum(e in entities[u] and term in terms[u] for u in set(texts))
                if support >= pii.SUPPORT and with_e < len(texts):
                    best = max(best, math.log2(both * len(texts) / (with_e * with_t)) / math.log2(len(texts) / with_e))
            if best >= pii.GENERALISE:
                found.append((start, end, "remove" if best >= pii.REMOVE else "generalise"))
        out[t] = found
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms(spark, seed):
    rnd = random.Random(seed)
    values = ["bob@x.org", "Bob@X.org", "ann@y.org", "1.2.3.4", "+1 202 555 0100"]
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Édouard", "the", "the", "the", "and", "12", "éz"]
    rows = [(i, "".join(rnd.choice([" ", ", ", ""]) + rnd.choice(rnd.choice([values, words, words, words])) + rnd.choice([" ", ".", " "])
                        for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    far = "Zorro start " + "pad " * 200 + "bob@x.org" + " pad" * 200 + " Yvain"
    rows += [(100, far), (101, far.replace("start", "other")), (102, None), (103, ""), (None, far), (100, far)]
    want = marked(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("hash", F.lit(0)).withColumn("spans", F.lit(1))
    found = pii.personal_data(df).collect()
    assert len(found) == len(rows) and sum(map(len, want.values())) > 20
    got = sorted((str(r.id), sorted((s.start, s.end, s.action) for s in r.added)) for r in found)
    assert got == sorted((str(k), sorted(want[t or ""])) for k, t in rows)
    # Edge words and far ones count like any other.
    assert (0, 5, "remove") in want[far] and (len(far) - 5, len(far), "remove") in want[far]


def test_many_values_in_one_text(spark):
    def text(n):
        return " ".join(f"name{i} user{i}@x{i}.org" for i in range(n))

    df = spark.createDataFrame([(1, text(20_000)), (2, text(20_000) + " more"), (3, "a b")], "doc_id long, text string")
    found = {r.id: r for r in pii.personal_data(df).collect()}
    assert len(found[1].spans) == 20_000 and len(found[1].added) == 20_000
    assert found[1].spans[-1].value == "user19999@x19999.org" and found[3].added == []


def test_sanitized_text(spark):
    rows = [(1, "call +1 202 555 0100 or 1.2.3.4 now"), (2, "x@1.2.3.4"), (3, "nothing"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit(3))
    out = pii.sanitized(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: "call [PHONE] or [IP] now", 2: "[EMAIL]", 3: "nothing", 4: None, 5: ""}


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
