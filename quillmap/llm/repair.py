"""Conversations whose turns do not alternate, repaired at least cost by Hirschberg's division.

A whole conversation is an optional system turn and then pairs of a user and an assistant turn. Rows are kept,
given another role or deleted, and empty turns are inserted, each at its cost. What is legal next depends on
one of four states: nothing yet, after system, after user, after assistant. The cheapest way through
the first half of the rows is a vector of four costs, found forwards, and that through the second half one found
backwards; where their sum is least the repair crosses from one half to the other, and both halves
are divided again, so that no table of all rows and states is ever kept.

Of equally cheap repairs the one whose list of edits sorts first is taken. Parts of two repairs that end with
the edit of the same row differ before either ends, so which comes first is settled there: forwards, the
four states carry the order of their lists of edits, and a crossing among equals takes the first.

Rows of a conversation may lie in many partitions. They are sorted into ranges; a conversation that lies within
one range and one block of ``BLOCK`` rows is repaired there. Of a longer one each block gives
its least costs between any two states, with the order of the edits, and each range those of its
blocks put together. Division over ranges, then over the blocks of a range, then over the rows of
a block finds the crossings. Only the digest of the repaired text runs through a conversation in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import query, table, written

#: Rows of a block, and characters of their texts.
BLOCK = 2048
BLOCK_TEXT = 1 << 20

#: Repeated texts of one conversation meet their first place in so many splits.
SPLITS = 8

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing yet, after system, after user, after assistant. A repair may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a user or assistant turn, whichever is next.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = "sua"
#: Row codes: role (system, user, assistant, other), plus ``CUT`` if truncated; ``GONE`` must be deleted.
OTHER, CUT, GONE = 3, 4, 8
_LEGAL = {(0, 1), (1, 2), (2, 1)}

_FAR = 1 << 50

Batches = Iterator[pa.RecordBatch]


class Step(NamedTuple):
    """Ways from one state to another: least cost, place of its edits in the order, and the edits, if there are any."""

    begin: int
    end: int
    cost: int
    order: int
    edits: str = ""


def row_steps(code: int) -> list[Step]:
    """All ways over one row: insertions, then what happens to the row."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    late = TRUNCATED if CUT <= code < GONE else 0
    kept = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}}
    for begin in STATES:
        state, spent, edits = begin, 0, ""
        # A third insertion only leads back.
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if code != GONE:
                ways.append((_NEXT[state], REROLE + late, "R"))
                if state in (moves := kept.get(code % CUT, {})):
                    ways.append((moves[state], late, "K"))
            for end, cost, edit in ways:
                way = (spent + cost, edits + edit)
                found[begin, end] = min(way, found.get((begin, end), way))
            state, spent, edits = _NEXT[state], spent + INSERT, edits + "I"
    order = {edits: i for i, edits in enumerate(sorted({e for _, e in found.values()}))}
    return [Step(b, e, cost, order[edits], edits) for (b, e), (cost, edits) in found.items()]


ROW_STEPS = [row_steps(code) for code in range(GONE + 1)]
ROW_EDITS = [{(s.begin, s.end): s.edits for s in steps} for steps in ROW_STEPS]

#: What has to be inserted at the end.
TAIL = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}

Items = Sequence[Sequence[Step]]


def forwards(items: Items, begin: int, first: int, last: int) -> tuple[list[int], list[int]]:
    """Least cost of each state after the items ``first`` to ``last``, and the order of their edits."""
    cost, order = [_FAR] * 4, [0] * 4
    cost[begin] = 0
    for i in range(first, last):
        best = [(_FAR, 0, 0)] * 4
        for b, e, c, o, _ in items[i]:
            way = (cost[b] + c, order[b], o)
            if way < best[e]:
                best[e] = way
        ranked = {key: n for n, key in enumerate(sorted({w[1:] for w in best if w[0] < _FAR}))}
        cost = [min(w[0], _FAR) for w in best]
        order = [ranked.get(w[1:], 0) for w in best]
    return cost, order


def backwards(items: Items, end: int, first: int, last: int) -> list[int]:
    """Least cost from each state over the items to ``end``."""
    cost = [_FAR] * 4
    cost[end] = 0
    for i in range(last - 1, first - 1, -1):
        new = [_FAR] * 4
        for b, e, c, _, _ in items[i]:
            new[b] = min(new[b], cost[e] + c)
        cost = new
    return cost


def crossings(items: Items, begin: int, end: int) -> list[int]:
    """The state before each item and after the last one, on the first of the cheapest ways."""
    states = [begin] * len(items) + [end]
    parts = [(0, len(items))]
    while parts:
        first, last = parts.pop()
        if last - first < 2:
            continue
        middle = (first + last) // 2
        cost, order = forwards(items, states[first], first, middle)
        rest = backwards(items, states[last], middle, last)
        states[middle] = min(STATES, key=lambda s: (cost[s] + rest[s], order[s]))
        parts += [(first, middle), (middle, last)]
    return states


def last_state(items: Items) -> tuple[int, int]:
    """Cost of the whole repair, and the state after the last item."""
    cost, order = forwards(items, START, 0, len(items))
    end = min(STATES, key=lambda s: (cost[s] + INSERT * TAIL[s], order[s]))
    return cost[end] + INSERT * TAIL[end], end


def together(items: Items) -> list[Step]:
    """One item that stands for all: the ways over them between any two states, without the edits."""
    steps = []
    for begin in STATES:
        cost, order = forwards(items, begin, 0, len(items))
        steps += [Step(begin, end, cost[end], order[end]) for end in STATES if cost[end] < _FAR]
    return steps


def applied(codes: bytes, roles: list[str | None], texts: list[str | None], begin: int, end: int) -> tuple[str, list[str]]:
    """Edits of the rows in order, and the lines ``role:text`` that stay or are inserted."""
    states = crossings([ROW_STEPS[c] for c in codes], begin, end)
    edits, lines = [], []
    for code, role, text, (state, after) in zip(codes, roles, texts, pairwise(states)):
        way = ROW_EDITS[code][state, after]
        edits.append(way)
        for _ in range(len(way) - 1):
            state = _NEXT[state]
            lines.append(f"{_ROLE[state]}:")
        if way[-1] != "D":
            lines.append(f"{role if way[-1] == 'K' else _ROLE[after]}:{text}")
    return "".join(edits), lines


def tail_lines(end: int) -> list[str]:
    lines = []
    for _ in range(TAIL[end]):
        end = _NEXT[end]
        lines.append(f"{_ROLE[end]}:")
    return lines


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_SUMS = ["blank", "duplicate", "truncated", "illegal"]
_STEPS = "array<struct<begin:int,end:int,cost:bigint,ord:int>>"
_PARTS = (
    "kind string, conv {conv}, range int, nth int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "head int, foot int, cost bigint, audit string, digest string, codes binary, roles array<string>, texts array<string>, "
    f"steps {_STEPS}"
)


def _plain(steps: list[Step]) -> list[dict]:
    return [{"begin": s.begin, "end": s.end, "cost": s.cost, "ord": s.order} for s in steps]


def _steps(rows: list[dict]) -> list[Step]:
    return [Step(r["begin"], r["end"], r["cost"], r["ord"]) for r in rows]


class _Conversation:
    """The rows of one conversation in one range, read in order."""

    def __init__(self, conv: object, at_edge: bool, size: int) -> None:
        self.conv, self.at_edge, self.most = conv, at_edge, size
        self.sums = dict.fromkeys(_SUMS, 0)
        self.head = self.foot = None
        self.blocks: list[list[Step]] = []
        self.codes, self.roles, self.texts, self.size = bytearray(), [], [], 0

    def add(self, row: dict) -> Iterator[dict]:
        """Take a row that stands ``times`` times; give blocks that are full."""
        kind = row["kind"]
        if self.foot is not None and (self.foot, kind) not in _LEGAL:
            self.sums["illegal"] += 1
        self.head, self.foot = kind if self.head is None else self.head, kind
        # Equal kinds are never legal neighbours.
        self.sums["illegal"] += row["times"] - 1
        fault = "blank" if row["blank"] else "duplicate" if row["seen"] else "truncated" if row["cut"] else None
        if fault:
            self.sums[fault] += row["times"] if fault != "truncated" else 1
        if fault in (None, "truncated"):
            self.sums["duplicate"] += row["times"] - 1
        left = row["times"]
        while left:
            first = left == row["times"] and fault in (None, "truncated")
            some = 1 if first else min(left, self.most - len(self.codes))
            self.codes += bytes([kind + CUT * bool(fault) if first else GONE]) * some
            self.roles += [row["role"] if first else None] * some
            self.texts += [row["text"] if first else None] * some
            self.size += len(row["text"]) if first else 0
            left -= some
            if len(self.codes) >= self.most or self.size >= BLOCK_TEXT:
                yield self.block()

    def block(self) -> dict:
        steps = together([ROW_STEPS[c] for c in self.codes])
        row = {"kind": "block", "conv": self.conv, "nth": len(self.blocks), "codes": bytes(self.codes), "roles": self.roles,
               "texts": self.texts, "steps": _plain(steps)}
        self.blocks.append(steps)
        self.codes, self.roles, self.texts, self.size = bytearray(), [], [], 0
        return row

    def close(self, at_edge: bool) -> Iterator[dict]:
        """The repaired conversation if all of it is here in one block, else what is left, and the range as one item."""
        if not (self.blocks or self.at_edge or at_edge):
            cost, end = last_state([ROW_STEPS[c] for c in self.codes])
            audit, lines = applied(bytes(self.codes), self.roles, self.texts, START, end)
            yield {"kind": "whole", "conv": self.conv, **self.sums, "cost": cost, "audit": audit + "I" * TAIL[end],
                   "digest": _digest(lines + tail_lines(end))}
            return
        if self.codes:
            yield self.block()
        yield {"kind": "range", "conv": self.conv, **self.sums, "head": self.head, "foot": self.foot, "steps": _plain(together(self.blocks))}


def _scan(schema: pa.Schema, block: int) -> Callable[[Batches], Batches]:
    def rows(batches: Batches) -> Iterator[dict]:
        current, first = None, True
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or row["conv"] != current.conv:
                    if current is not None:
                        yield from current.close(at_edge=False)
                        first = False
                    current = _Conversation(row["conv"], first, block)
                yield from current.add(row)
        if current is not None:
            yield from current.close(at_edge=True)

    def run(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        held, size = [], 0
        for row in rows(batches):
            held.append({"range": task, **row})
            size += 1 + sum(map(len, filter(None, row.get("texts", []))))
            if len(held) >= 1000 or size >= BLOCK_TEXT:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _across_ranges(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Totals of a conversation from its ranges, and the states at their edges."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("range").to_pylist()
        items = [_steps(r["steps"]) for r in rows]
        cost, end = last_state(items)
        states = crossings(items, START, end)
        sums = {name: sum(r[name] for r in rows) for name in _SUMS}
        sums["illegal"] += sum((a["foot"], b["head"]) not in _LEGAL for a, b in pairwise(rows))
        out = [
            {"conv": r["conv"], "range": r["range"], "begin": a, "end": b, "final": i + 1 == len(rows),
             **{k: v if i + 1 == len(rows) else None for k, v in {**sums, "cost": cost}.items()}}
            for i, (r, (a, b)) in enumerate(zip(rows, pairwise(states)))
        ]
        return pa.Table.from_pylist(out, schema)

    return run


def _across_blocks(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The states at the edges of the blocks of one range."""

    def run(blocks: pa.Table, edges: pa.Table) -> pa.Table:
        rows = blocks.sort_by("nth").to_pylist()
        edge = edges.to_pylist()[0]
        states = crossings([_steps(r["steps"]) for r in rows], edge["begin"], edge["end"])
        return pa.Table.from_pylist([
            {"conv": r["conv"], "range": r["range"], "nth": r["nth"], "begin": a, "end": b, "final": edge["final"] and i + 1 == len(rows)}
            for i, (r, (a, b)) in enumerate(zip(rows, pairwise(states)))
        ], schema)

    return run


def _repaired(schema: pa.Schema) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit, lines = applied(r["codes"], r["roles"], r["texts"], r["begin"], r["end"])
                if r["final"]:
                    audit, lines = audit + "I" * TAIL[r["end"]], lines + tail_lines(r["end"])
                out.append({"conv": r["conv"], "range": r["range"], "nth": r["nth"], "audit": audit, "lines": "\n".join(lines) if lines else None})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _streamed_digests(schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Digest of each conversation from the lines of its blocks, which come in order; only one block is held."""

    def run(batches: Batches) -> Batches:
        conv, digest, empty, some = None, None, True, False
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if not some or row["conv"] != conv:
                    if some:
                        done.append({"conv": conv, "digest": digest.hexdigest()})
                    conv, digest, empty, some = row["conv"], hashlib.sha256(), True, True
                if row["lines"] is not None:
                    digest.update(("" if empty else "\n").encode() + row["lines"].encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(done, schema)
        if some:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "digest": digest.hexdigest()}], schema)

    return run


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_BLANK = r"[\x20\x09-\x0D]"


def _faulty(rows: DataFrame) -> DataFrame:
    """Different rows with how many times they stand, and what is wrong with them."""
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    equal = written(equal.withColumn("hash", F.sha2("text", 256)).withColumn("place", F.struct(F.col("turn").isNotNull(), "turn")), "turns")
    # Texts at several places of a conversation; a row is seen before if it is not at the first one.
    first = equal.groupBy("conv", "role", "hash").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("places"))
    split = F.pmod(F.hash("turn"), F.lit(SPLITS))
    first = first.where("places > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first",
        F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("s"),
    )
    met = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")) & (split == F.col("s"))
    kind = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1)) - 1
    ends_well = F.col("text").rlike(rf"[.!?]{_BLANK}*\z")
    return equal.join(first, met, "left").select(
        "conv", "turn", "role", "text", "times", "hash",
        F.when((F.col("role") == "") | (kind < 0), OTHER).otherwise(kind).cast("int").alias("kind"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~ends_well).alias("cut"),
        F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("seen"),
    )


def repairs(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: ``conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows of a conversation go by turn, nulls first, those of one turn by role and text. A row is blank without
    a character other than blanks, else a duplicate if its role and text came before, else truncated
    if the last such character is none of ``.!?``. Blank rows and duplicates are deleted. ``illegal`` counts
    neighbours whose roles may not follow each other. ``audit`` has the first letters of the edits (keep, rerole, delete,
    insert), ``repaired_sha256`` is of the lines ``role:text`` afterwards. Null roles and texts count as one blank, a null
    identifier is a conversation of its own. No rows give no rows; other columns are not read. A conversation of
    any size is divided over tasks; its audit is one string, and its text is digested by one task, block by block.
    """
    spark = rows.sparkSession
    blank: Callable[[str], Column] = lambda c: F.coalesce(F.col(c), F.lit(" "))
    given = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    conv = given.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text"]
    ordered = _faulty(given).repartitionByRange("conv", "turn", "role", "hash").sortWithinPartitions(*order)
    ddl = _PARTS.format(conv=conv)
    parts = written(ordered.drop("turn", "hash").mapInArrow(_scan(_arrow(spark, ddl), block), ddl), "conversation-parts")

    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = parts.where("kind = 'whole'").select("conv", *names, F.col("digest").alias("repaired_sha256"))

    edges_ddl = f"conv {conv}, range int, begin int, end int, final boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    ranges = parts.where("kind = 'range'").select("conv", "range", *_SUMS, "head", "foot", "steps")
    # A group has one row per range.
    edges = written(ranges.groupBy("conv").applyInArrow(_across_ranges(_arrow(spark, edges_ddl)), edges_ddl), "range-edges")
    blocks = parts.where("kind = 'block'")
    states_ddl = f"conv {conv}, range int, nth int, begin int, end int, final boolean"
    # A group has the blocks of one range, without their texts.
    states = blocks.select("conv", "range", "nth", "steps").groupBy("conv", "range").cogroup(
        edges.select("conv", "range", "begin", "end", "final").groupBy("conv", "range")
    ).applyInArrow(_across_blocks(_arrow(spark, states_ddl)), states_ddl)
    states = states.select("range", "nth", "begin", "end", "final", F.col("conv").alias("of"))
    # A range number and a block number may occur in several conversations.
    opened = blocks.select("conv", "range", "nth", "codes", "roles", "texts").join(states, ["range", "nth"]).where(F.col("conv").eqNullSafe(F.col("of")))
    lines_ddl = f"conv {conv}, range int, nth int, audit string, lines string"
    lines = written(opened.drop("of").mapInArrow(_repaired(_arrow(spark, lines_ddl)), lines_ddl), "repaired-blocks")
    digest_ddl = f"conv {conv}, digest string"
    in_order = lines.select("conv", "range", "nth", "lines").repartition("conv").sortWithinPartitions("conv", "range", "nth")
    digests = in_order.mapInArrow(_streamed_digests(_arrow(spark, digest_ddl)), digest_ddl)
    pieces = F.array_sort(F.collect_list(F.struct("range", "nth", "audit")))
    audits = lines.groupBy("conv").agg(F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    totals = edges.where("final").select("conv", *_SUMS, "cost")
    divided = _by_conversation(_by_conversation(totals, audits), digests.withColumnRenamed("digest", "repaired_sha256"))
    return whole.unionByName(divided.select("conv", *names, "repaired_sha256"))


def _by_conversation(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    other = right.withColumnRenamed("conv", "other_conv")
    return left.join(other, F.col("conv").eqNullSafe(F.col("other_conv")), how).drop("other_conv")


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` of the rows after a fault that the checksum of ``conv_id:turn`` picks for some of them."""
    blank: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    words = F.when(pick == 1, F.lit("")).when(pick == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(pick == 4, F.lit("user")).otherwise(blank(role)).alias("role"),
        words.alias("text"), F.explode(F.when(pick == 0, F.array()).when(pick == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = written(damaged(conversations), "damaged-turns")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(F.col("conv_id").alias("conv")).agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    found = _by_conversation(_by_conversation(every, gaps, "left"), repairs(rows), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
