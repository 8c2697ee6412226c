import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pyarrow.parquet as pq
from helpers import apply
from pyspark.sql import functions as F

from quillmap.checks import QUERIES
from quillmap.operators import board, journal, outline, purposes
from quillmap.streaming import changes as ch
from quillmap.streaming.parts import BurstParts
from quillmap.plans.export import write_board
from quillmap.plans.storage import fresh_folder

EVENT = "repo string, seq bigint, action string, task_id string, title string, suited string, by string"


def test_board_round_trip(spark):
    rows = [
        ("p", 1, "claim", "t-001", None, None, "early"), ("p", 2, "add", None, "Build", "ui, ,e2e", None),
        ("p", 3, "add", None, "Test", None, None), ("p", 4, "claim", "t-001", None, None, "a"),
        ("p", 5, "done", "t-001", None, None, None), ("p", 6, "claim", "t-002", None, None, None),
        ("p", 7, "done", "t-009", None, None, None), ("p", 8, "done", "t-002", None, None, None),
        ("p", 9, "claim", "t-002", None, None, "b"), ("p", 10, "add", None, "Ship", "", None),
    ]
    events = spark.createDataFrame(rows, EVENT)
    added = board.added_tasks(events)
    tasks = board.fold_board(events, added)
    got = {r.id: (r.title, r.suited, r.status, r.claimed_by) for r in tasks.collect()}
    assert got == {
        "t-001": ("Build", ["ui", "e2e"], "done", "a"), "t-002": ("Test", [], "claimed", "b"),
        "t-003": ("Ship", [], "open", None),
    }
    assert sorted(r.seq for r in board.rejected_events(events, added).collect()) == [1, 7]
    text = "\n".join(r.text for r in board.board_lines(tasks).orderBy("rank", "id").collect())
    assert text == (
        "# Tasks\n\nGenerated from tasks.json — do not hand-edit.\n\n## open\n- **t-003** Ship\n\n"
        "## claimed\n- **t-002** Test — @b\n\n## done\n- **t-001** Build — @a _(suited: ui, e2e)_"
    )
    assert board.tasks_text(tasks).first().text == "### Open tasks\n- t-002 Test [] (claimed by b)\n- t-003 Ship []"
    folder = fresh_folder(spark, "board")
    write_board(tasks, folder + "/json", folder + "/board")
    lines = spark.read.text(folder + "/json/repo=p").collect()
    assert sorted(json.loads(r.value)["status"] for r in lines) == ["claimed", "done", "open"]
    assert spark.read.text(folder + "/board/repo=p").count() == len(text.split("\n"))
    existing = tasks.withColumn("id", F.lit("t-999"))
    assert {r.id for r in board.added_tasks(events, existing).collect()} == {"t-1000", "t-1001", "t-1002"}


def test_outline_and_blocks(spark):
    plans = ["# A\n\n  text  \n## B\n### C\n\n#### D\n#x\ny", "plain\n\nno heading", "", "# last", "# A\n" + "z" * 130]
    assert apply(spark, plans, outline.plan_outline) == [
        "# A\n  text\n## B\n### C\n  #### D", "", "", "# last", "# A\n  " + "z" * 120,
    ]
    logs = ["# L\n\n## a\nx\n## b\ny\n\n## c\n", "## only", "none", ""]
    assert apply(spark, logs, lambda c: outline.recent_blocks(c, 2)) == ["## a\nx\n\n## b\ny", "## only", "", ""]


def test_journal(spark):
    t1, t2 = datetime(2024, 1, 1, 23, 30), datetime(2024, 1, 2)
    notes = spark.createDataFrame(
        [("r", t1, 1, "a", "s1", "n1", "", None), ("r", t2, 2, "", "s2", "", "g", "f")],
        "repo string, ts timestamp, seq int, from_agent string, stopped string, next string, gotchas string, files string",
    )
    configs = spark.createDataFrame([("r", "bot")], "repo string, agent_name string")
    doc = journal.handoff_documents(notes, configs).first()
    assert doc.front == {"updated": "2024-01-02T00:00:00.000Z", "fromAgent": "bot"}
    assert doc.body == (
        "# Handoff\n\n**Where I stopped:** s2\n\n**What to do next:** …\n\n"
        "**Gotchas / watch out for:** g\n\n**Files I touched:** f\n"
    )
    decisions = spark.createDataFrame(
        [("r", t1, i, f"d{i}") for i in range(8)] + [("q", t1, 1, "z")], "repo string, ts timestamp, seq int, text string"
    )
    recent = journal.recent_decisions(decisions)
    assert sorted(r.text for r in recent.filter("repo = 'r'").collect()) == ["d3", "d4", "d5", "d6", "d7"]
    texts = {r.repo: r.text for r in journal.decisions_text(recent).collect()}
    assert texts["q"] == "## 2024-01-01 — z\n\nz" and texts["r"].startswith("## 2024-01-01 — d7\n\nd7\n\n##")


def test_answers(spark):
    raw = [("r", datetime(2024, 1, 1), '```json\n{"a": " one ", "b": "", "c": "x"}\n```'), ("r", datetime(2024, 1, 2), '{"a": "two"}'),
           ("r", datetime(2024, 1, 3), "{oops")]
    answers = purposes.parse_answers(spark.createDataFrame(raw, "repo string, ts timestamp, raw string"))
    index = spark.createDataFrame(
        [("r", "a", "old", True), ("r", "b", None, False), ("r", "d", "keep", True)],
        "repo string, path string, purpose string, purpose_stale boolean",
    )
    applied = purposes.apply_answers(index, answers)
    got = {r.path: (r.purpose, r.purpose_stale, r.applied) for r in applied.collect()}
    assert got == {"a": ("two", False, True), "b": (None, False, False), "d": ("keep", True, False)}
    assert purposes.applied_counts(applied).first().applied == 1


CHANGE = "repo string, path string, content string, ts timestamp"


def settings(spark):
    return spark.createDataFrame(
        [("r", ["express"], {}, ["skip/**"])],
        "repo string, stack array<string>, extractors map<string,boolean>, ignore array<string>",
    )


def test_stored_batches(spark):
    path = fresh_folder(spark, "index")
    at = lambda m: datetime(2024, 1, 1, 0, m)
    first = [("r", "a.ts", "export const a = 1", at(0)), ("r", "b.ts", "app.get('/x')", at(0)),
             ("r", "a.ts", "export const a2 = 1", at(1)), ("r", "skip/c.ts", "", at(0)),
             ("r", "node_modules/d.ts", "", at(0)), ("r", "e.md", "", at(0))]
    second = [("r", "b.ts", None, at(2)), ("r", "a.ts", "export const a3 = 1", at(3)), ("r", "f.ts", "", at(2))]
    assert ch.current_index(spark, path) is None
    for batch, rows in [(0, first), (1, second), (1, second)]:
        ch.store_batch(spark.createDataFrame(rows, CHANGE), batch, path, settings(spark))
    got = {r.path: ([e.name for e in r.exports], r.state) for r in ch.current_index(spark, path).collect()}
    assert got == {"a.ts": (["a3"], "changed"), "f.ts": ([], "new")}
    old = {r.path: [x.url for x in r.routes] for r in ch.current_index(spark, path, before=1).collect()}
    assert old == {"a.ts": [], "b.ts": ["/x"]}
    target = fresh_folder(spark, "compacted")
    ch.compact(spark, path, target)
    assert {r.path for r in ch.current_index(spark, target).collect()} == {"a.ts", "f.ts"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [[("r", f"f{i}.ts", f"export const v{i}_{n} = 1", datetime(2024, 1, 1, 0, n)) for i in range(n, n + 4)] for n in range(3)]
    source = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    path, log = fresh_folder(spark, "stream"), fresh_folder(spark, "log")
    ch.stream_index(stream, path, log, settings(spark)).awaitTermination()
    whole = fresh_folder(spark, "whole")
    ch.store_batch(spark.read.parquet(source), 0, whole, settings(spark))
    columns = ["repo", "path", "hash", "exports"]
    read = lambda p: sorted(map(str, ch.current_index(spark, p).select(columns).collect()))
    assert read(path) == read(whole) and len(read(path)) == 6


def test_streamed_bursts_are_those_at_rest(spark):
    """Several batches, changes out of order, repositories in several splits, bursts that are open at the end."""
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(rnd.choice("pqr"), f"f{rnd.randrange(30)}", start + timedelta(milliseconds=50 * i + rnd.randint(0, 400)) + timedelta(seconds=3 * (i // 40)))
            for i in range(400)]
    source = fresh_folder(spark, "moves")
    schema = "repo string, path string, ts timestamp"
    for k in range(4):
        spark.createDataFrame(rows[k * 100: (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, log = fresh_folder(spark, "parts"), fresh_folder(spark, "parts-log")
    ch.stream_bursts(stream, path, log, gap="300 milliseconds", lateness="2 seconds", splits=3).awaitTermination()
    columns = ["repo", "first_change", "last_change", "changes"]
    read = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    want = read(ch.bursts(spark.read.schema(schema).parquet(source), "300 milliseconds"))
    assert read(ch.streamed_bursts(spark, path, log, "300 milliseconds")) == want and len(want) > 10
    closed = read(ch.streamed_bursts(spark, path, log, "300 milliseconds", closing=False))
    assert 0 < len(closed) < len(want)
    # A stream that goes on later takes up the state.
    more = [("p", "x", max(r[2] for r in rows) + timedelta(milliseconds=100)), ("z", "x", start + timedelta(days=1))]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    ch.stream_bursts(stream, path, log, gap="300 milliseconds", lateness="2 seconds", splits=3).awaitTermination()
    want = read(ch.bursts(spark.read.schema(schema).parquet(source), "300 milliseconds"))
    assert read(ch.streamed_bursts(spark, path, log, "300 milliseconds")) == want


def test_bursts(spark):
    ms = lambda n: datetime(2024, 1, 1, 0, 0, 0, n * 1000)
    rows = [("r", "a", ms(0)), ("r", "b", ms(200)), ("r", "c", ms(449)), ("r", "d", ms(700)), ("r", ".gitignore", ms(600)),
            ("r", None, ms(500)), ("q", "x", ms(0))]
    changes = spark.createDataFrame(rows, "repo string, path string, ts timestamp")
    for found in (ch.bursts(changes, buckets=3), ch.bursts(changes)):
        assert sorted((r.repo, r.changes) for r in found.collect()) == [("q", 1), ("r", 1), ("r", 3)]


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"export const x{i} = 1;", "en", "src1") for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    documents.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    events = [(i, i % 3, start_of(i), "click", 1.0) for i in range(30)]
    events = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, value double")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    (tmp_path / "file").mkdir()
    for name, df in (("documents", documents), ("events", events)):
        pq.write_table(df.toArrow(), f"{tmp_path}/file/{name}.parquet")
    for name in ("streamed_index", "streamed_bursts"):
        found = [sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{kind}").collect()), key=str) for kind in ("folder", "file")]
        assert found[0] == found[1] and found[0]
    assert sum(r[-1] for r in found[0]) == 30


def start_of(i):
    return datetime(2024, 1, 1) + timedelta(hours=i)


class Handle:
    """State and timers of one key, with a count of the calls."""

    def __init__(self):
        self.parts, self.timers, self.calls = [], set(), 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "getListState": lambda *_: self, "get": lambda: iter(list(self.parts)), "put": lambda v: self.parts.__setitem__(slice(None), v),
            "clear": self.parts.clear, "registerTimer": self.timers.add, "deleteTimer": self.timers.remove, "listTimers": lambda: iter(sorted(self.timers)),
        }[name]


def test_parts_of_a_key_cost_few_calls(spark):
    parts, handle, mark = BurstParts(100), Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    parts.init(handle)
    at = lambda ms: SimpleNamespace(ts=datetime.fromtimestamp(ms / 1000))
    list(parts.handleInputRows(("r", 0), iter([at(1000 * i) for i in range(50)]), mark))
    assert len(handle.parts) == 50 and handle.calls <= 6 and handle.timers == {101}
    list(parts.handleInputRows(("r", 0), iter([at(-50), at(90)]), mark))
    assert handle.timers == {191} and len(handle.parts) == 50
    handle.calls, now = 0, SimpleNamespace(getCurrentWatermarkInMs=lambda: 30_050)
    out = list(parts.handleExpiredTimer(("r", 0), now, SimpleNamespace(getExpiryTimeInMs=lambda: 191)))
    assert [(r.first_change, r.last_change, r.changes) for r in out[:2]] == [(-50_000, 90_000, 3), (1_000_000, 1_000_000, 1)]
    # What ends at 30 s can still go on; its timer takes the place of the one that expired.
    assert len(out) == 30 and len(handle.parts) == 20 and handle.calls <= 3 and 30_101 in handle.timers
