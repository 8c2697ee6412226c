"""Conversation repair against a plain search over all edits, whole and divided over blocks and ranges."""

import functools
import hashlib
import os
import random
import re
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from quillmap.llm import repair
from quillmap.llm.queries import QUERIES

SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
PATTERN = re.compile("(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def fits(prefix):
    return any(PATTERN.fullmatch(prefix + end) for end in ("", "a", "ua"))


def search(rows):
    """Least (cost, audit, lines), with the roles so far as the state."""
    found = faults(rows)

    def state(roles):  # Longer lists of roles go on as their last pair does.
        pairs = roles.removeprefix("s")
        return roles[:len(roles) - len(pairs)] + pairs[:2 - len(pairs) % 2]

    @functools.cache
    def best(i, roles, inserted):
        ways = []
        if i == len(rows) and PATTERN.fullmatch(roles):
            ways.append((0, "", ()))
        if inserted < 3:
            for r in "ua":
                if fits(roles + r):
                    cost, audit, lines = best(i, state(roles + r), inserted + 1)
                    ways.append((cost + 3, "I" + audit, (ROLE[r] + ":", *lines)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, lines = best(i + 1, roles, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if found[i] not in ("blank", "duplicate"):
                late = 3 if found[i] else 0
                for edit, r, line, price in [("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)]:
                    if r and r in "sua" and fits(roles + r):
                        cost, audit, lines = best(i + 1, state(roles + r), 0)
                        ways.append((cost + price + late, edit + audit, (f"{line}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    cost, audit, lines = search(tuple(rows))
    found = faults(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (*(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", "admin", None]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "Yes.  \n", "", " \t", None, "é…", "a\nb."]


def conversation(rnd, n):
    return [(rnd.choice(ROLES), rnd.choice(TEXTS) if rnd.random() < 0.6 else f"t{rnd.random()}.") for _ in range(n)]


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    return sorted(((c, *brute([r[2:] for r in sorted(g)])) for c, g in groups.items()), key=str)


def test_states():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(r or " ", t or " ") for r, t in conversation(rnd, rnd.randint(1, 9))]
        codes = []
        for (role, _), fault in zip(rows, faults(rows)):
            kind = "sua".find(role[0]) if role and role[0] in "sua" else repair.OTHER
            codes.append(repair.GONE if fault in ("blank", "duplicate") else kind + repair.CUT * bool(fault))
        items = [repair.ROW_STEPS[c] for c in codes]
        cost, end = repair.last_state(items)
        audit, lines = repair.applied(bytes(codes), *zip(*rows), repair.START, end)
        want = search(tuple(rows))
        assert (cost, audit + "I" * repair.TAIL[end], tuple(lines + repair.tail_lines(end))) == want
        # Rows put together in any portions are crossed alike.
        cuts = sorted({0, len(items), *(rnd.randint(0, len(items)) for _ in range(3))})
        blocks = [repair.together(items[a:b]) for a, b in pairwise(cuts)]
        assert repair.last_state(blocks) == (cost, end)
        states = repair.crossings(items, repair.START, end)
        assert repair.crossings(blocks, repair.START, end) == [states[c] for c in cuts]


@pytest.mark.parametrize("block", [3, 2048])
def test_divided(spark, block):
    rnd = random.Random(block)
    rows = []
    for conv, n in [(None, 5), (1, 70), *((c, rnd.randint(1, 9)) for c in range(2, 60))]:
        turns = sorted(rnd.choice([None, *range(2 * n)]) or 0 for _ in range(n))
        rows += [(conv, t or None, *r) for t, r in zip(turns, conversation(rnd, n))]
    rows += [(1, 7, "user", "Yes.")] * 9 + [(99, None, "assistant", " ")] * 8
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumn("range", F.lit(1)).withColumn("conv", F.lit("x")).withColumn("kind", F.lit(2))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, repair.repairs(df, block=block).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repairs(df).collect() == [] and repair.damaged(df).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")
def test_query(spark):
    groups = {}
    for r in sorted(spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        rows = groups.setdefault(r.conv_id, [])
        pick = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if pick == 1 else re.sub("[.!?]", "", r.text) if pick == 2 else r.text
        rows += [(r.turn, "user" if pick == 4 else r.role, text)] * {0: 0, 3: 2}.get(pick, 1)
    want = []
    for conv, rows in groups.items():
        turns = {t for t, _, _ in rows}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want.append((conv, gaps, *brute([r[1:] for r in rows])))
    df = QUERIES["op13_conversation_repair"](spark, SF_DIR)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
