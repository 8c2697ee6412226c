"""Checks of snapshots, purposes, boards, journals and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.checks import derived as d
from quillmap.checks.catalog import query, union_all
from quillmap.checks.extract_checks import EXPORTS, IMPORTS
from quillmap.checks.file_checks import DIR_SQL, TRIM_SET
from quillmap.functions import text as t
from quillmap.operators import board, journal, outline, purposes, snapshot, validate
from quillmap.operators.extract.registry import apply_gates, extract_ungated
from quillmap.plans.export import task_json_rows
from quillmap.plans.status import status_reports
from quillmap.sources.documents import first_filled_lines, read_markdown, write_markdown_text
from quillmap.sources.files import source_files

# --- snapshots ---------------------------------------------------------------
CURRENT = """
    SELECT f.repo, f.path, substring(sha1(f.content), 1, 8) AS hash, f.doc_id, f.n_chars,
           l.quality, l.toxic,
           CASE WHEN l.doc_id IS NULL OR l.quality = 0 THEN 'new'
                WHEN l.toxic = 1 THEN 'changed' ELSE 'reused' END AS state
    FROM doc_files f LEFT JOIN labels l ON l.doc_id = f.doc_id
"""
_PURPOSE = "CASE WHEN state <> 'new' AND n_chars > 300 THEN 'about ' || CAST(doc_id AS STRING) END"


def current_files(spark: SparkSession, sf: str) -> DataFrame:
    return d.derive(spark, sf, "doc_files").select(
        "repo", "path", t.short_hash(F.col("content")).alias("hash"),
        t.line_count(F.col("content")).alias("loc"), "lang",
    )


def carried(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.carry_over(current_files(spark, sf), d.derive(spark, sf, "snapshot_prev"))


@query(
    "carried_purposes",
    f"""SELECT repo, path, hash, {_PURPOSE} AS purpose,
            CASE state WHEN 'reused' THEN n_chars > 2000 WHEN 'changed' THEN n_chars > 300
                 ELSE false END AS purpose_stale, state
        FROM ({CURRENT})""",
    ("doc_files",),
)
def carried_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return carried(spark, sf).select("repo", "path", "hash", "purpose", "purpose_stale", "state")


@query(
    "run_counters",
    f"""SELECT repo, count(*) FILTER (WHERE state <> 'reused') AS parsed,
            count(*) FILTER (WHERE state = 'reused') AS reused FROM ({CURRENT}) GROUP BY repo""",
    ("doc_files",),
)
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.run_counters(carried(spark, sf))


@query(
    "read_errors",
    "SELECT repo, count(*) AS errors FROM doc_files WHERE lang = 'fr' GROUP BY repo",
    ("doc_files",),
)
def read_errors(spark: SparkSession, sf: str) -> DataFrame:
    listed = d.derive(spark, sf, "doc_files")
    return snapshot.count_errors(listed, listed.filter(F.col("lang") != "fr"))


@query(
    "repo_stats",
    f"""SELECT repo, count(*) AS files, count(*) AS indexed_files,
            CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS loc
        FROM doc_files WHERE {d.DOC_IS_SOURCE} GROUP BY repo""",
    ("doc_files",),
)
def repo_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = source_files(d.derive(spark, sf, "doc_files"))
    return snapshot.repo_stats(
        files.select("repo", "path", t.line_count(F.col("content")).alias("loc"))
    )


@query(
    "path_statuses",
    f"""SELECT repo, path, CASE state WHEN 'reused' THEN 'same' WHEN 'changed' THEN 'modified'
               ELSE 'new' END AS status FROM ({CURRENT})
        UNION ALL SELECT repo, 'old/' || path, 'deleted' FROM ({CURRENT}) WHERE quality = 0""",
    ("doc_files",),
)
def path_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.compare(current_files(spark, sf), d.derive(spark, sf, "snapshot_prev"))


@query(
    "deleted_paths",
    f"SELECT repo, 'old/' || path AS path FROM ({CURRENT}) WHERE quality = 0",
    ("doc_files",),
)
def deleted_paths(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.deleted_paths(current_files(spark, sf), d.derive(spark, sf, "snapshot_prev"))


def drift_counts(spark: SparkSession, sf: str) -> DataFrame:
    previous = d.derive(spark, sf, "snapshot_prev").filter(~F.endswith("repo", F.lit("7")))
    return snapshot.drift(current_files(spark, sf), previous, previous)


@query(
    "drift",
    f"""SELECT repo, CASE WHEN repo LIKE '%7' OR NOT bool_or(state <> 'new' OR quality = 0) THEN -1
            ELSE count(*) FILTER (WHERE state <> 'reused') + count(*) FILTER (WHERE quality = 0)
            END AS changed
        FROM ({CURRENT}) GROUP BY repo""",
    ("doc_files",),
)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    return drift_counts(spark, sf)


_MTIME = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * doc_id"
_INDEXED_AT = f"""
    SELECT source AS repo, max({_MTIME}) AS indexed_at FROM documents
    WHERE source NOT LIKE '%7' AND lang <> 'en' GROUP BY source"""


@query(
    "index_freshness",
    f"""SELECT repo, CASE WHEN i.indexed_at IS NULL THEN 'no index'
                WHEN newest > i.indexed_at THEN 'stale' ELSE 'fresh' END AS freshness
        FROM (SELECT repo, max(CASE WHEN split_part(path, '/', 1) IN ('src', 'app', 'pages', 'lib')
                              THEN {_MTIME} END) AS newest FROM doc_files GROUP BY repo)
        LEFT JOIN ({_INDEXED_AT}) i USING (repo)""",
    ("doc_files",),
)
def index_freshness(spark: SparkSession, sf: str) -> DataFrame:
    files = d.derive(spark, sf, "doc_files").withColumn("mtime", F.expr(_MTIME))
    return snapshot.freshness(files, d.run_sql(spark, sf, _INDEXED_AT))


@query(
    "directory_counts",
    f"""SELECT repo, {DIR_SQL} AS dir, count(*) AS files FROM doc_files GROUP BY 1, 2""",
    ("doc_files",),
)
def directory_counts(spark: SparkSession, sf: str) -> DataFrame:
    from quillmap.operators.listing import directory_counts as counts

    return counts(d.derive(spark, sf, "doc_files"))


# --- purposes ----------------------------------------------------------------
@query(
    "stale_purposes",
    f"""SELECT repo, path FROM ({CURRENT}) WHERE state = 'new' OR n_chars <= 300
            OR (state = 'reused' AND n_chars > 2000) OR (state = 'changed' AND n_chars > 300)""",
    ("doc_files",),
)
def stale_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return purposes.stale_files(carried(spark, sf)).select("repo", "path")


_CUST = {"k": d.as_text("c_custkey"), "n": d.as_text("c_nationkey")}


def _item(seg: str) -> str:
    symbols = ", ".join(f"{n} ({k})" for n, k in EXPORTS[seg])
    modules = ", ".join(IMPORTS[seg])
    path = "src/mods/m<<k>>.ts"
    return d.text_sql(f"- {path}\n    exports: {symbols}\n    imports: {modules}", **_CUST)


REQUEST_ITEMS = union_all([
    f"SELECT 'org' || CAST(c_nationkey AS STRING) AS repo, {_item(seg)} AS item "
    f"FROM customer WHERE c_mktsegment = '{seg}'"
    for seg in EXPORTS
])


def module_index(spark: SparkSession, sf: str) -> DataFrame:
    files = d.derive(spark, sf, "module_files")
    repos = files.select("repo").distinct().select(
        "repo", F.array().cast("array<string>").alias("stack"),
        F.create_map().cast("map<string,boolean>").alias("extractors"),
    )
    return snapshot.first_snapshot(apply_gates(extract_ungated(files), repos))


@query("request_items", REQUEST_ITEMS)
def request_items(spark: SparkSession, sf: str) -> DataFrame:
    return purposes.request_items(module_index(spark, sf)).select("repo", "item")


@query(
    "request_lines",
    f"""SELECT repo, item AS text FROM ({REQUEST_ITEMS})
        UNION ALL SELECT DISTINCT 'org' || CAST(c_nationkey AS STRING),
               '{purposes.REQUEST_HEAD}' FROM customer""",
)
def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    return purposes.request_lines(module_index(spark, sf)).select("repo", "text")


_RAW = """
    SELECT repo, ts, CASE lang WHEN 'fr' THEN 'sorry {' || path
        WHEN 'de' THEN '{"' || path || '": "   ", "gone.ts": "x"}'
        WHEN 'es' THEN '{"' || path || '": "  uno ' || CAST(doc_id AS STRING) || '  "}'
        ELSE '```json' || chr(10) || '{"' || path || '": "first ' || CAST(doc_id AS STRING) || '"}'
             || chr(10) || '```' END AS raw
    FROM ({answers})
    UNION ALL
    SELECT repo, ts + INTERVAL '1' DAY, '{"' || path || '": "later ' || CAST(doc_id AS STRING) || '"}'
    FROM ({answers}) WHERE lang = 'en'"""


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return d.run_sql(spark, sf, _RAW.replace("({answers})", f"({d.DERIVED['answers']})"))


@query(
    "parsed_answers",
    """SELECT repo, path, 'uno ' || CAST(doc_id AS STRING) AS purpose FROM answers WHERE lang = 'es'
       UNION ALL SELECT repo, path, 'first ' || CAST(doc_id AS STRING) FROM answers WHERE lang = 'en'
       UNION ALL SELECT repo, path, 'later ' || CAST(doc_id AS STRING) FROM answers WHERE lang = 'en'
       UNION ALL SELECT repo, 'gone.ts', 'x' FROM answers WHERE lang = 'de'""",
    ("answers",),
)
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    return purposes.parse_answers(_responses(spark, sf)).drop("ts")


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    answers = purposes.parse_answers(_responses(spark, sf))
    return purposes.apply_answers(carried(spark, sf), answers)


_ANSWER = (
    "CASE lang WHEN 'es' THEN 'uno ' || CAST(doc_id AS STRING) "
    "WHEN 'en' THEN 'later ' || CAST(doc_id AS STRING) END"
)
_APPLIED = f"""
    SELECT c.repo, c.path, {_ANSWER.replace('doc_id', 'c.doc_id')} AS answer, {_PURPOSE.replace('doc_id', 'c.doc_id').replace('n_chars', 'c.n_chars')} AS purpose,
           CASE state WHEN 'reused' THEN c.n_chars > 2000 WHEN 'changed' THEN c.n_chars > 300
                ELSE false END AS stale
    FROM ({CURRENT}) c JOIN documents dd ON dd.doc_id = c.doc_id"""


@query(
    "applied_purposes",
    f"""SELECT repo, path, coalesce(answer, purpose) AS purpose,
            CASE WHEN answer IS NULL THEN stale ELSE false END AS purpose_stale FROM ({_APPLIED})""",
    ("doc_files",),
)
def applied_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).select("repo", "path", "purpose", "purpose_stale")


@query(
    "applied_counts",
    f"SELECT repo, count(answer) AS applied FROM ({_APPLIED}) GROUP BY repo",
    ("doc_files",),
)
def applied_counts(spark: SparkSession, sf: str) -> DataFrame:
    return purposes.applied_counts(_applied(spark, sf))


# --- board -------------------------------------------------------------------
_ADDED = """
    SELECT repo, seq AS add_seq, title, suited IS NOT NULL AS is_suited,
           't-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS n
          FROM task_events WHERE action = 'add')"""
_VALID = f"""
    SELECT e.repo, e.seq, e.action, e.task_id AS id, coalesce(e."by", 'unknown') AS actor, a.add_seq
    FROM task_events e LEFT JOIN ({_ADDED}) a ON a.repo = e.repo AND a.id = e.task_id
    WHERE e.action <> 'add'"""
_BOARD = f"""
    SELECT a.repo, a.id, a.title, a.is_suited,
           CASE f.last_action WHEN 'claim' THEN 'claimed' WHEN 'done' THEN 'done' ELSE 'open' END AS status,
           f.last_by AS claimed_by
    FROM ({_ADDED}) a LEFT JOIN (
        SELECT repo, id, arg_max(action, seq) AS last_action,
               arg_max(actor, seq) FILTER (WHERE action = 'claim') AS last_by
        FROM ({_VALID}) WHERE seq > add_seq GROUP BY repo, id) f
    ON f.repo = a.repo AND f.id = a.id"""


def _board(spark: SparkSession, sf: str) -> DataFrame:
    events = d.derive(spark, sf, "task_events")
    return board.fold_board(events, board.added_tasks(events))


@query(
    "added_tasks",
    f"""SELECT repo, id, title, CASE WHEN is_suited THEN 'ui|test|e2e' ELSE '' END AS suited, add_seq
        FROM ({_ADDED})""",
    ("task_events",),
)
def added_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return board.added_tasks(d.derive(spark, sf, "task_events")).select(
        "repo", "id", "title", F.array_join("suited", "|").alias("suited"), "add_seq"
    )


@query(
    "numbered_on",
    """SELECT repo, 't-' || lpad(CAST(n + 100 + length(repo) AS STRING), 3, '0') AS id, title
       FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS n
             FROM task_events WHERE action = 'add')""",
    ("task_events",),
)
def numbered_on(spark: SparkSession, sf: str) -> DataFrame:
    events = d.derive(spark, sf, "task_events")
    number = (F.lit(100) + F.length("repo")).cast("bigint")
    existing = events.select("repo").distinct().select(
        "repo", F.explode(F.array(board.task_id(number), F.lit("x-999"), F.lit("t-9z"))).alias("id")
    )
    return board.added_tasks(events, existing).select("repo", "id", "title")


@query(
    "highest_task_numbers",
    "SELECT repo, count(*) AS highest FROM task_events WHERE action = 'add' GROUP BY repo",
    ("task_events",),
)
def highest_task_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return board.highest_numbers(board.added_tasks(d.derive(spark, sf, "task_events")))


@query("folded_board", f"SELECT repo, id, status, claimed_by FROM ({_BOARD})", ("task_events",))
def folded_board(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf).select("repo", "id", "status", "claimed_by")


@query(
    "rejected_task_events",
    f"SELECT repo, seq, action, id FROM ({_VALID}) WHERE add_seq IS NULL OR seq <= add_seq",
    ("task_events",),
)
def rejected_task_events(spark: SparkSession, sf: str) -> DataFrame:
    events = d.derive(spark, sf, "task_events")
    return board.rejected_events(events, board.added_tasks(events)).select(
        "repo", "seq", "action", "id"
    )


@query(
    "status_counts",
    f"SELECT repo, status, count(*) AS tasks FROM ({_BOARD}) GROUP BY 1, 2",
    ("task_events",),
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return board.status_counts(_board(spark, sf)).drop("rank")


_RANK = "CASE status WHEN 'open' THEN 1 WHEN 'claimed' THEN 2 ELSE 5 END"


@query(
    "board_lines",
    f"""WITH b AS ({_BOARD})
        SELECT repo, {_RANK} AS rank, id, '- **' || id || '** ' || title
               || CASE WHEN claimed_by IS NULL THEN '' ELSE ' — @' || claimed_by END
               || CASE WHEN is_suited THEN ' _(suited: ui, test, e2e)_' ELSE '' END AS text FROM b
        UNION ALL SELECT DISTINCT repo, {_RANK}, '', chr(10) || '## ' || status FROM b
        UNION ALL SELECT DISTINCT repo, 0, '', '{fx.BOARD_HEAD}' FROM b""",
    ("task_events",),
)
def board_lines(spark: SparkSession, sf: str) -> DataFrame:
    return board.board_lines(_board(spark, sf))


@query(
    "unfinished_tasks",
    f"""SELECT repo, id, id || ' ' || status || ' ' || title
               || CASE WHEN is_suited THEN ' [ui, test, e2e]' ELSE '' END
               || CASE WHEN claimed_by IS NULL THEN '' ELSE ' @' || claimed_by END AS text
        FROM ({_BOARD}) WHERE status <> 'done'""",
    ("task_events",),
)
def unfinished_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return board.unfinished_tasks(_board(spark, sf))


BUNDLE_TASKS = f"""
    SELECT repo, rank, id, '- ' || id || ' ' || title
           || CASE WHEN is_suited THEN ' [ui,test,e2e]' ELSE ' []' END
           || CASE WHEN claimed_by IS NULL THEN '' ELSE ' (claimed by ' || claimed_by || ')' END AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS rank
          FROM ({_BOARD}) WHERE status IN ('open', 'claimed')) WHERE rank <= 10"""


@query(
    "first_open_tasks",
    f"SELECT repo, CAST(rank AS INTEGER) AS rank, id, line FROM ({BUNDLE_TASKS})",
    ("task_events",),
)
def first_open_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return board.bundle_tasks(_board(spark, sf))


@query(
    "tasks_section",
    f"""SELECT repo, '### Open tasks' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text
        FROM ({BUNDLE_TASKS}) GROUP BY repo""",
    ("task_events",),
)
def tasks_section(spark: SparkSession, sf: str) -> DataFrame:
    return board.tasks_text(_board(spark, sf))


@query(
    "task_json",
    f"""SELECT repo, id, '{{"id":"' || id || '","title":"' || title || '","suited":'
               || CASE WHEN is_suited THEN '["ui","test","e2e"]' ELSE '[]' END
               || ',"status":"' || status || '","claimedBy":'
               || coalesce('"' || claimed_by || '"', 'null') || ',"notes":"","deps":[]}}' AS text
        FROM ({_BOARD})""",
    ("task_events",),
)
def task_json(spark: SparkSession, sf: str) -> DataFrame:
    return task_json_rows(_board(spark, sf))


# --- journal -----------------------------------------------------------------
_ENTRY = f"""'## ' || strftime(ts, '%Y-%m-%d') || ' — ' || CASE WHEN length(text) > 60
    THEN rtrim(left(text, 57), {TRIM_SET}) || '…' ELSE text END || chr(10) || chr(10) || text"""


@query("decision_entries", f"SELECT repo, seq, {_ENTRY} AS entry FROM decisions", ("decisions",))
def decision_entries(spark: SparkSession, sf: str) -> DataFrame:
    return journal.decision_entries(d.derive(spark, sf, "decisions")).drop("ts")


@query(
    "recent_decisions",
    """SELECT repo, seq, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo
           ORDER BY ts DESC, seq DESC) AS rank FROM decisions) WHERE rank <= 5""",
    ("decisions",),
)
def recent_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return journal.recent_decisions(d.derive(spark, sf, "decisions")).select("repo", "seq", "rank")


@query(
    "recent_decisions_text",
    f"""SELECT repo, string_agg({_ENTRY}, chr(10) || chr(10) ORDER BY rank) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, seq DESC) AS rank
              FROM decisions) WHERE rank <= length(repo) - 4 GROUP BY repo""",
    ("decisions",),
)
def recent_decisions_text(spark: SparkSession, sf: str) -> DataFrame:
    decisions = d.derive(spark, sf, "decisions")
    limits = decisions.select("repo").distinct().withColumn(
        "decisions_in_context", (F.length("repo") - 4).cast("bigint")
    )
    return journal.decisions_text(journal.recent_decisions(decisions, limits))


@query(
    "recent_blocks",
    f"""SELECT conv_id, turn, '## one' || chr(10) || trim(text, {TRIM_SET}) || chr(10) || chr(10) || chr(10)
               || '## two' || chr(10) || '### sub' || chr(10) || 'x' AS recent FROM conversations""",
)
def recent_blocks(spark: SparkSession, sf: str) -> DataFrame:
    log = F.concat(
        F.lit("# Log\n\n## one\n"), t.trim(F.col("text")),
        F.lit("\n\n## two\n### sub\nx\n## three\ny\n"),
    )
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", outline.recent_blocks(log, 2).alias("recent")
    )


@query(
    "plan_outlines",
    f"""SELECT conv_id, turn, '# Title' || chr(10) || '  '
               || left(trim(split_part(text, chr(10), 1), {TRIM_SET}), 120) || chr(10)
               || '## Next' || chr(10) || '### Deep' || chr(10) || '  tail' AS outline
        FROM conversations""",
)
def plan_outlines(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.concat(F.lit("# Title\n  \n"), F.col("text"), F.lit("\n## Next\n### Deep\n\n  tail  \n#### x\n"))
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", outline.plan_outline(plan).alias("outline")
    )


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, seq DESC) AS rn FROM handoffs) WHERE rn = 1"


@query(
    "latest_handoffs", f"SELECT repo, seq, from_agent, stopped, next FROM ({_LATEST})", ("handoffs",)
)
def latest_handoffs(spark: SparkSession, sf: str) -> DataFrame:
    return journal.latest_handoffs(d.derive(spark, sf, "handoffs")).select(
        "repo", "seq", "from_agent", "stopped", "next"
    )


_AGENT = "CASE WHEN from_agent = '' THEN 'unknown' ELSE from_agent END"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'"
_HANDOFF_TEXT = """'# Handoff' || chr(10) || chr(10) || '**Where I stopped:** ' || stopped
    || chr(10) || chr(10) || '**What to do next:** ' || next
    || chr(10) || chr(10) || '**Gotchas / watch out for:** '
    || CASE WHEN gotchas = '' THEN '…' ELSE gotchas END
    || chr(10) || chr(10) || '**Files I touched:** …' || chr(10)"""


def handoff_documents_of(spark: SparkSession, sf: str) -> DataFrame:
    return journal.handoff_documents(d.derive(spark, sf, "handoffs"))


@query(
    "handoff_documents",
    f"""SELECT repo, '---' || chr(10) || 'fromAgent: ' || {_AGENT} || chr(10) || 'updated: ' || {_ISO}
               || chr(10) || '---' || chr(10) || {_HANDOFF_TEXT} AS text FROM ({_LATEST})""",
    ("handoffs",),
)
def handoff_documents(spark: SparkSession, sf: str) -> DataFrame:
    return handoff_documents_of(spark, sf).select(
        "repo", write_markdown_text(F.col("front"), F.col("body")).alias("text")
    )


def stamped_states(spark: SparkSession, sf: str) -> DataFrame:
    states = read_markdown(d.derive(spark, sf, "state_documents"))
    return journal.stamp_state(states, handoff_documents_of(spark, sf))


@query(
    "stamped_states",
    f"""SELECT repo, coalesce({_ISO}, '2023-12-31T10:11:12.000Z') AS updated,
               coalesce({_AGENT}, 'nobody') AS last_agent, 'setup: one' AS phase
        FROM (SELECT DISTINCT 'conv' || CAST(conv_id AS STRING) AS repo FROM conversations)
        LEFT JOIN ({_LATEST}) USING (repo)""",
    ("handoffs",),
)
def stamped_state_fields(spark: SparkSession, sf: str) -> DataFrame:
    front: Column = F.col("front")
    return stamped_states(spark, sf).select(
        "repo", front["updated"].alias("updated"), front["lastAgent"].alias("last_agent"),
        front["phase"].alias("phase"),
    )


@query(
    "handoff_previews",
    f"""SELECT repo, array_to_string(list_filter(string_split({_HANDOFF_TEXT}, chr(10)),
               lambda x: trim(x, {TRIM_SET}) <> '')[:6], chr(10)) AS preview FROM ({_LATEST})""",
    ("handoffs",),
)
def handoff_previews(spark: SparkSession, sf: str) -> DataFrame:
    return handoff_documents_of(spark, sf).select(
        "repo", first_filled_lines(F.col("body"), fx.HANDOFF_PREVIEW_LINES).alias("preview")
    )


_CHANGED = "CASE length(repo) WHEN 5 THEN NULL WHEN 6 THEN 0 ELSE 3 END"


@query(
    "status_reports",
    f"""SELECT repo, 'State' || chr(10) || 'updated ' || coalesce({_ISO}, '2023-12-31T10:11:12.000Z')
               || ' · lastAgent ' || coalesce({_AGENT}, 'nobody') || ' · phase setup: one' || chr(10)
               || chr(10) || '# State of ' || substring(repo, 5) || chr(10) || chr(10)
               || CASE WHEN stopped IS NULL THEN '' ELSE 'Last handoff' || chr(10)
                  || trim(array_to_string(list_filter(string_split({_HANDOFF_TEXT}, chr(10)),
                       lambda x: trim(x, {TRIM_SET}) <> '')[:6], chr(10)), {TRIM_SET})
                  || chr(10) || chr(10) END
               || 'Index' || chr(10) || CASE WHEN {_CHANGED} IS NULL THEN 'no index yet'
                   WHEN {_CHANGED} = 0 THEN 'up to date'
                   ELSE '3 file(s) changed since last index' END || chr(10) || chr(10) AS text
        FROM (SELECT DISTINCT 'conv' || CAST(conv_id AS STRING) AS repo FROM conversations)
        LEFT JOIN ({_LATEST}) USING (repo)""",
    ("handoffs",),
)
def status(spark: SparkSession, sf: str) -> DataFrame:
    states = stamped_states(spark, sf)
    documents = states.unionByName(handoff_documents_of(spark, sf))
    changed = F.expr(_CHANGED).cast("bigint")
    drift_rows = states.select("repo", changed.alias("changed")).filter(F.col("changed").isNotNull())
    return status_reports(documents, drift_rows)


# --- validation --------------------------------------------------------------
_SUPP = {"k": d.as_text("s_suppkey")}
_N = len(d.INDEX_DOCUMENTS)


@query(
    "snapshot_problems",
    union_all([
        f"SELECT s_name AS repo, {pos} AS pos, '{problem}' AS problem FROM supplier "
        f"WHERE s_suppkey % {_N} = {kind}"
        for kind, found in enumerate(d.INDEX_PROBLEMS)
        for pos, problem in enumerate(found)
    ]),
)
def snapshot_problems(spark: SparkSession, sf: str) -> DataFrame:
    return validate.snapshot_problems(d.derive(spark, sf, "index_documents"))


@query(
    "read_snapshots",
    f"""SELECT s_name AS repo, {d.text_sql("a<<k>>.ts", **_SUPP)} AS path,
               {d.text_sql("h<<k>>", **_SUPP)} AS hash, {d.text_sql("p<<k>>", **_SUPP)} AS purpose,
               true AS purpose_stale, 'x' AS exports, 'y' AS imports
        FROM supplier WHERE s_suppkey % {_N} = 0""",
)
def read_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    files = validate.snapshot_files(
        validate.read_snapshots(d.derive(spark, sf, "index_documents"))
    )
    return files.select(
        "repo", "path", "hash", "purpose", "purpose_stale",
        F.array_join(F.transform("exports", lambda e: e["name"]), "|").alias("exports"),
        F.array_join("imports", "|").alias("imports"),
    )
