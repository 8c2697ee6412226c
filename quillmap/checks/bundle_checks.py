"""Checks of listings, budgets, bundles, JSON documents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.checks import derived as d
from quillmap.checks import extract_checks as ec
from quillmap.checks import project_checks as pc
from quillmap.checks.catalog import query, union_all
from quillmap.checks.file_checks import DIR_SQL, TRIM_SET
from quillmap.operators import board, budget, listing, snapshot, tables
from quillmap.operators.extract.registry import apply_gates, extract_ungated
from quillmap.plans import bundle, export
from quillmap.plans.index import build_index
from quillmap.plans.storage import fresh_folder, materialize
from quillmap.sources.files import source_files
from quillmap.streaming import changes as ch

# --- budget over any sections ------------------------------------------------
_TRIMMED = f"""
    SELECT repo, priority, name, trim(body, {TRIM_SET}) AS body, trim(collapsed, {TRIM_SET}) AS collapsed
    FROM conv_sections"""


def greedy_sql(sections: str) -> str:
    """Greedy choice over ``repo, priority, name, body, collapsed, budget`` as SQL rows."""
    return f"""
    measured AS (
        SELECT *, CAST(ceil(length(body) / 4.0) AS BIGINT) AS f,
               CAST(ceil(length(collapsed) / 4.0) AS BIGINT) AS c,
               row_number() OVER (PARTITION BY repo ORDER BY priority) AS rn
        FROM ({sections})),
    walk AS (
        SELECT DISTINCT repo, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, '' AS form FROM measured
        UNION ALL
        SELECT m.repo, m.rn,
               w.used + CASE WHEN w.used + f <= budget THEN f
                             WHEN c > 0 AND w.used + c <= budget THEN c ELSE 0 END,
               CASE WHEN w.used + f <= budget THEN 'full'
                    WHEN c > 0 AND w.used + c <= budget THEN 'collapsed' ELSE 'dropped' END
        FROM walk w JOIN measured m ON m.repo = w.repo AND m.rn = w.rn + 1),
    chosen AS (
        SELECT m.repo, m.priority, m.name, w.form,
               CASE w.form WHEN 'full' THEN m.body WHEN 'collapsed' THEN m.collapsed END AS text
        FROM walk w JOIN measured m ON m.repo = w.repo AND m.rn = w.rn)"""


_CONV_GREEDY = greedy_sql(f"SELECT *, 200 AS budget FROM ({_TRIMMED})")


@query(
    "section_forms",
    f"WITH RECURSIVE {_CONV_GREEDY} SELECT repo, priority, name, form FROM chosen",
    ("conv_sections",),
)
def section_forms(spark: SparkSession, sf: str) -> DataFrame:
    return budget.section_forms(d.derive(spark, sf, "conv_sections"), 200)


@query(
    "budgeted_assembly",
    f"""WITH RECURSIVE {_CONV_GREEDY}
        SELECT repo, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, kept, collapsed
        FROM (SELECT repo,
                  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY priority)
                           FILTER (WHERE form <> 'dropped'), '') AS text,
                  coalesce(string_agg(name, '|' ORDER BY priority) FILTER (WHERE form = 'full'), '') AS kept,
                  coalesce(string_agg(name, '|' ORDER BY priority) FILTER (WHERE form = 'collapsed'), '')
                      AS collapsed
              FROM chosen GROUP BY repo)""",
    ("conv_sections",),
)
def budgeted_assembly(spark: SparkSession, sf: str) -> DataFrame:
    bundles = budget.assemble(d.derive(spark, sf, "conv_sections"), 200)
    return bundles.withColumn("kept", F.array_join("kept", "|")).withColumn(
        "collapsed", F.array_join("collapsed", "|")
    )


# --- a map of documents ------------------------------------------------------
def doc_settings(spark: SparkSession, sf: str) -> DataFrame:
    return d.run_sql(
        spark, sf,
        """SELECT source AS repo, source AS project_name, CAST(array() AS array<string>) AS stack,
                  CAST(map() AS map<string, boolean>) AS extractors,
                  CAST(array() AS array<string>) AS ignore,
                  CAST(60 + 20 * CAST(substring(source, 4) AS INT) AS BIGINT) AS context_budget,
                  CAST(5 AS BIGINT) AS decisions_in_context
           FROM (SELECT DISTINCT source FROM documents)""",
    )


def doc_index(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extract_ungated(source_files(d.derive(spark, sf, "doc_files")))
    current = apply_gates(extracted, doc_settings(spark, sf))
    return materialize(
        snapshot.carry_over(current, d.derive(spark, sf, "snapshot_prev")), "doc-index"
    )


DOC_ROWS = f"""
    SELECT f.repo, f.path, {DIR_SQL.replace('path', 'f.path')} AS dir, f.content, f.doc_id,
           {d.doc_case(2).replace("doc_id", "f.doc_id")} AS lang_name,
           substring(sha1(f.content), 1, 8) AS hash,
           CASE WHEN l.quality <> 0 AND f.n_chars > 300
                THEN 'about ' || CAST(f.doc_id AS STRING) END AS purpose,
           CASE WHEN l.quality <> 0 AND f.n_chars > 300 AND (l.toxic = 1 OR f.n_chars > 2000)
                THEN true ELSE false END AS stale
    FROM (SELECT * FROM doc_files WHERE {d.DOC_IS_SOURCE}) f
    LEFT JOIN labels l ON l.doc_id = f.doc_id"""
_DOC_FULL = f"""
    SELECT repo, dir, path AS k, '  ' || CASE WHEN dir = '.' THEN path ELSE path[length(dir) + 2:] END
           || coalesce(' — ' || purpose, '') AS line FROM ({DOC_ROWS})
    UNION ALL SELECT DISTINCT repo, dir, '', dir || '/' FROM ({DOC_ROWS})"""
_DOC_SHORT = f"""
    SELECT repo, dir, '- ' || dir || '/ — ' || CAST(count(*) AS STRING) || ' file'
           || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS line FROM ({DOC_ROWS}) GROUP BY repo, dir"""


@query(
    "file_listing_lines",
    f"""SELECT repo, 'full' AS form, line FROM ({_DOC_FULL})
        UNION ALL SELECT repo, 'collapsed', line FROM ({_DOC_SHORT})""",
    ("doc_files",),
)
def file_listing_lines(spark: SparkSession, sf: str) -> DataFrame:
    return listing.file_lines(doc_index(spark, sf)).select("repo", "form", "line")


_DOC_TEXTS = f"""
    full_text AS (SELECT repo, '### Files' || chr(10)
        || string_agg(line, chr(10) ORDER BY dir, k COLLATE en_us) AS body FROM ({_DOC_FULL}) GROUP BY repo),
    short_text AS (SELECT repo, '### Files (summary)' || chr(10)
        || string_agg(line, chr(10) ORDER BY dir COLLATE en_us) AS collapsed
        FROM ({_DOC_SHORT}) GROUP BY repo),
    head_text AS (SELECT repo, '## Codebase Map' || chr(10) || chr(10) || '_'
        || CAST(count(*) AS STRING) || ' files, '
        || CAST(sum(len(string_split(content, chr(10)))) AS STRING) || ' lines_' AS body
        FROM ({DOC_ROWS}) GROUP BY repo)"""


@query(
    "section_costs",
    f"""WITH {_DOC_TEXTS}
        SELECT repo, 'full' AS form, CAST(ceil(length(body) / 4.0) AS BIGINT) AS tokens FROM full_text
        UNION ALL SELECT repo, 'collapsed', CAST(ceil(length(collapsed) / 4.0) AS BIGINT)
        FROM short_text""",
    ("doc_files",),
)
def section_costs(spark: SparkSession, sf: str) -> DataFrame:
    costs = listing.section_costs(listing.file_lines(doc_index(spark, sf)))
    return costs.select("repo", "form", "tokens")


def _bundle_sql(sections: str, known: str, setup: str) -> str:
    header = f"'{bundle.DEFAULT_HEADER}'"
    return f"""WITH RECURSIVE {setup}, {greedy_sql(sections)},
        bodies AS (SELECT repo, string_agg(text, chr(10) || chr(10) ORDER BY priority) AS body
                   FROM chosen WHERE form <> 'dropped' GROUP BY repo)
        SELECT repo, {header} || chr(10) || coalesce(body, '{bundle.HINT_INDEXED}') || chr(10) AS text,
               CAST(ceil(coalesce(length(body), 0) / 4.0) + ceil(length({header}) / 4.0) AS BIGINT) AS tokens
        FROM ({known}) LEFT JOIN bodies USING (repo)"""


@query(
    "bundles",
    _bundle_sql(
        """SELECT repo, 6 AS priority, 'map-head' AS name, body, NULL AS collapsed,
                  60 + 20 * CAST(substring(repo, 4) AS INT) AS budget FROM head_text
           UNION ALL
           SELECT repo, 10, 'files', body, collapsed, 60 + 20 * CAST(substring(repo, 4) AS INT)
           FROM full_text JOIN short_text USING (repo)""",
        "SELECT DISTINCT source AS repo FROM documents",
        _DOC_TEXTS,
    ),
    ("doc_files",),
)
def bundles(spark: SparkSession, sf: str) -> DataFrame:
    no_documents = spark.createDataFrame([], "repo string, doc string, body string")
    no_tasks = spark.createDataFrame([], "repo string, id string, title string, suited array<string>, status string, claimed_by string")
    return bundle.bundles(doc_index(spark, sf), doc_settings(spark, sf), no_documents, no_tasks)


# --- the map of made-up code -------------------------------------------------
def code_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return build_index(ec.code_files(spark, sf), d.derive(spark, sf, "org_configs"))


_ROUTE_LINE = "'- ' || method || ' ' || path || '  →  ' || file"
_TABLE_LINE = (
    "'- ' || name || CASE engine WHEN 'postgres' THEN '' ELSE ' (' || engine || ')' END || ': ' "
    "|| replace(columns, '|', ', ')"
)
_COMPONENT_LINE = (
    "'- ' || name || CASE WHEN props = '' THEN '' ELSE ' (' || replace(props, '|', ', ') || ')' END "
    "|| CASE WHEN client THEN ' [client]  ' ELSE ' [server]  ' END || file"
)


def _gated_index(spark: SparkSession, sf: str) -> DataFrame:
    return ec.gated_index(spark, sf)


@query("route_lines", f"SELECT repo, {_ROUTE_LINE} AS line FROM ({ec.GATED_ROUTES})")
def route_lines(spark: SparkSession, sf: str) -> DataFrame:
    return listing.route_lines(tables.routes(_gated_index(spark, sf))).select("repo", "line")


@query("table_lines", f"SELECT repo, {_TABLE_LINE} AS line FROM ({ec.GATED_TABLES})")
def table_lines(spark: SparkSession, sf: str) -> DataFrame:
    return listing.db_lines(tables.db_tables(_gated_index(spark, sf))).select("repo", "line")


@query("component_lines", f"SELECT repo, {_COMPONENT_LINE} AS line FROM ({ec.GATED_COMPONENTS})")
def component_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.components(_gated_index(spark, sf))
    return listing.component_lines(rows).select("repo", "line")


@query(
    "component_counts",
    f"SELECT repo, count(*) AS components FROM ({ec.GATED_COMPONENTS}) GROUP BY repo",
)
def component_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.components(_gated_index(spark, sf)).groupBy("repo").agg(
        F.count("*").alias("components")
    )


def _files(org: str, path: str, names: str, table: str, where: str = "true") -> str:
    return (
        f"SELECT 'org' || CAST({org} AS STRING) AS repo, {path} AS path, {names} AS names "
        f"FROM {table} WHERE {where}"
    )


_ORD = {"k": d.as_text("o_orderkey")}
_CUS = {"k": d.as_text("c_custkey"), "n": d.as_text("c_nationkey")}
_PAR = {"k": d.as_text("p_partkey")}
CODE_FILES = union_all(
    [
        _files(
            "c_nationkey", "'src/mods/m' || CAST(c_custkey AS STRING) || '.ts'",
            d.text_sql(", ".join(n for n, _ in symbols[: fx.LISTED_EXPORTS]), **_CUS),
            "customer", f"c_mktsegment = '{seg}'",
        )
        for seg, symbols in ec.EXPORTS.items()
    ]
    + [_files("c_nationkey", "'src/servers/s' || CAST(c_custkey AS STRING) || '.js'", "''", "customer")]
    + [
        _files("o_custkey % 25", d.WEB_PATH, f"'{names}'", "orders", f"o_orderstatus = '{s}'")
        for s, names in [("P", "POST, GET"), ("O", "DELETE"), ("F", "GETTER, HEAD")]
    ]
    + [
        _files(
            "p_partkey % 25", "'src/ui/C' || CAST(p_partkey AS STRING) || '.tsx'",
            d.text_sql(name, **_PAR), "part", f"p_type = '{kind}'",
        )
        for kind, name in [
            ("MEDIUM", "Card<<k>>"), ("STANDARD", "Plain<<k>>"), ("ECONOMY", "Nothing<<k>>"),
            ("PROMO", "Twice<<k>>"), ("LARGE", "Wide<<k>>"), ("SMALL", "Tiny<<k>>"),
        ]
    ]
    + [
        _files("p_partkey % 25", "'db/p' || CAST(p_partkey AS STRING) || '.sql'", "''", "part"),
        _files("p_partkey % 25", "'models/p' || CAST(p_partkey AS STRING) || '.prisma'", "''", "part"),
        _files(
            "p_partkey % 25", "'src/store/p' || CAST(p_partkey AS STRING) || '.ts'",
            "CASE WHEN p_type = 'PROMO' THEN 'mongoose' ELSE '' END", "part",
        ),
        _files(
            "s_nationkey", "'src/supabase/types' || CAST(s_suppkey AS STRING) || '.ts'",
            "'Database'", "supplier",
        ),
    ]
)


@query("listed_exports", CODE_FILES)
def listed_exports(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform(F.slice("exports", 1, fx.LISTED_EXPORTS), lambda e: e["name"])
    return _gated_index(spark, sf).select("repo", "path", F.array_join(names, ", ").alias("names"))


_CODE_TEXT = union_all([
    f"SELECT repo, content FROM ({d.DERIVED[name]})" for name in ec.CODE_INPUTS
])
_ORG_STACK = (
    "CASE org % 5 WHEN 0 THEN '**Stack:** nextjs, react' WHEN 1 THEN '**Stack:** express, mongoose' "
    "WHEN 2 THEN '**Stack:** prisma' WHEN 3 THEN '**Stack:** react, supabase' ELSE '' END"
)
_CODE_SETUP = f"""
    code AS (SELECT *, {DIR_SQL} AS dir FROM ({CODE_FILES})),
    orgs AS (SELECT n_nationkey AS org, 'org' || CAST(n_nationkey AS STRING) AS repo,
             CASE n_nationkey % 4 WHEN 0 THEN CAST('100' || CAST(n_nationkey AS STRING) AS BIGINT)
                  ELSE 2000 END AS budget FROM nation),
    head_text AS (SELECT repo, '## Codebase Map' || chr(10) || {_ORG_STACK} || chr(10) || '_'
        || CAST(files AS STRING) || ' files, ' || CAST(loc AS STRING) || ' lines_' AS body
        FROM orgs JOIN (SELECT repo, count(*) AS files, sum(len(string_split(content, chr(10)))) AS loc
                        FROM ({_CODE_TEXT}) GROUP BY repo) USING (repo)),
    route_text AS (SELECT repo, '### Routes' || chr(10) || string_agg({_ROUTE_LINE}, chr(10)
        ORDER BY path COLLATE en_us, method COLLATE en_us, file COLLATE en_us) AS body
        FROM ({ec.GATED_ROUTES}) GROUP BY repo),
    table_text AS (SELECT repo, '### Data model' || chr(10) || string_agg({_TABLE_LINE}, chr(10)
        ORDER BY CASE engine WHEN 'postgres' THEN 1 WHEN 'prisma' THEN 2 ELSE 3 END,
                 name COLLATE en_us, source COLLATE en_us, pos) AS body
        FROM ({ec.GATED_TABLES}) GROUP BY repo),
    component_text AS (SELECT repo, '### Components' || chr(10) || string_agg({_COMPONENT_LINE}, chr(10)
        ORDER BY name COLLATE en_us, file COLLATE en_us) AS body,
        '### Components' || chr(10) || '- ' || CAST(count(*) AS STRING) || ' components' AS collapsed
        FROM ({ec.GATED_COMPONENTS}) GROUP BY repo),
    full_text AS (SELECT repo, '### Files' || chr(10) || string_agg(line, chr(10)
        ORDER BY dir, k COLLATE en_us) AS body FROM (
            SELECT repo, dir, path AS k, '  ' || path[length(dir) + 2:]
                   || CASE WHEN names = '' THEN '' ELSE ' — ' || names END AS line FROM code
            UNION ALL SELECT DISTINCT repo, dir, '', dir || '/' FROM code) GROUP BY repo),
    short_text AS (SELECT repo, '### Files (summary)' || chr(10)
        || string_agg('- ' || dir || '/ — ' || CAST(n AS STRING) || ' file'
                      || CASE WHEN n = 1 THEN '' ELSE 's' END, chr(10) ORDER BY dir COLLATE en_us) AS collapsed
        FROM (SELECT repo, dir, count(*) AS n FROM code GROUP BY repo, dir) GROUP BY repo)"""


@query(
    "code_bundles",
    _bundle_sql(
        """SELECT repo, priority, name, body, collapsed, budget FROM (
               SELECT repo, 6 AS priority, 'map-head' AS name, body, NULL AS collapsed FROM head_text
               UNION ALL SELECT repo, 7, 'routes', body, NULL FROM route_text
               UNION ALL SELECT repo, 8, 'db', body, NULL FROM table_text
               UNION ALL SELECT repo, 9, 'components', body, collapsed FROM component_text
               UNION ALL SELECT repo, 10, 'files', body, collapsed
                   FROM full_text JOIN short_text USING (repo)) JOIN orgs USING (repo)""",
        "SELECT repo FROM orgs",
        _CODE_SETUP,
    ),
)
def code_bundles(spark: SparkSession, sf: str) -> DataFrame:
    index, settings = code_index(spark, sf)
    no_documents = spark.createDataFrame([], "repo string, doc string, body string")
    no_tasks = spark.createDataFrame([], "repo string, id string, title string, suited array<string>, status string, claimed_by string")
    return bundle.bundles(index, settings, no_documents, no_tasks)


# --- bundles of project logs -------------------------------------------------
def _log_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    states = pc.stamped_states(spark, sf)
    handoffs = pc.handoff_documents_of(spark, sf)
    plans = d.run_sql(
        spark, sf,
        "SELECT 'conv' || CAST(conv_id AS STRING) AS repo, 'plan' AS doc, "
        "'# Plan' || chr(10) || text AS body FROM conversations WHERE role = 'system'",
    )
    decisions = pc.recent_decisions_text(spark, sf).select(
        "repo", F.lit("decisions").alias("doc"), F.concat(F.lit("# Log\n\n"), F.col("text")).alias("body")
    )
    documents = states.select("repo", "doc", "body").unionByName(
        handoffs.select("repo", "doc", "body")
    )
    documents = documents.unionByName(plans).unionByName(decisions)
    settings = states.select(
        "repo", F.array().cast("array<string>").alias("stack"),
        F.lit(300).cast("bigint").alias("context_budget"),
        F.lit(1).cast("bigint").alias("decisions_in_context"),
    )
    events = d.derive(spark, sf, "task_events")
    tasks = board.fold_board(events, board.added_tasks(events)).withColumn(
        "repo", F.replace("repo", F.lit("user"), F.lit("conv"))
    )
    return documents, settings, tasks


_LOG_SECTIONS = f"""
    SELECT repo, 1 AS priority, 'state' AS name,
           '## Current State' || chr(10) || '# State of ' || substring(repo, 5) AS body
    FROM (SELECT DISTINCT 'conv' || CAST(conv_id AS STRING) AS repo FROM conversations)
    UNION ALL
    SELECT repo, 2, 'handoff', '## Last Handoff' || chr(10) || rtrim({pc._HANDOFF_TEXT}, {TRIM_SET})
    FROM ({pc._LATEST})
    UNION ALL
    SELECT replace(repo, 'user', 'conv'), 3, 'tasks', '## Tasks' || chr(10) || '### Open tasks' || chr(10)
           || string_agg(line, chr(10) ORDER BY rank) FROM ({pc.BUNDLE_TASKS}) GROUP BY repo
    UNION ALL
    SELECT 'conv' || CAST(conv_id AS STRING), 4, 'plan', '## Plan' || chr(10) || '# Plan' || chr(10)
           || '  ' || rtrim(left(trim(split_part(text, chr(10), 1), {TRIM_SET}), 120), {TRIM_SET})
    FROM conversations WHERE role = 'system'
    UNION ALL
    SELECT repo, 5, 'decisions', '## Recent Decisions' || chr(10) || rtrim({pc._ENTRY}, {TRIM_SET})
    FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, seq DESC) AS rank
          FROM decisions) WHERE rank = 1"""


@query(
    "log_sections",
    f"SELECT repo, priority, name, body FROM ({_LOG_SECTIONS})",
    ("handoffs", "decisions", "task_events"),
)
def log_sections(spark: SparkSession, sf: str) -> DataFrame:
    documents, settings, tasks = _log_inputs(spark, sf)
    sections = bundle.document_sections(documents, settings).unionByName(bundle.task_sections(tasks))
    trimmed = F.regexp_replace("body", r"\s+\z", "")
    return sections.select("repo", "priority", "name", trimmed.alias("body"))


@query(
    "log_bundles",
    f"""WITH RECURSIVE {greedy_sql(f"SELECT *, NULL AS collapsed, CASE WHEN repo IN (SELECT 'conv' || CAST(conv_id AS STRING) FROM conversations) THEN 300 ELSE 2000 END AS budget FROM ({_LOG_SECTIONS})")}
        SELECT repo, '{bundle.DEFAULT_HEADER}' || chr(10)
               || string_agg(text, chr(10) || chr(10) ORDER BY priority) || chr(10) AS text
        FROM chosen WHERE form <> 'dropped' GROUP BY repo""",
    ("handoffs", "decisions", "task_events"),
)
def log_bundles(spark: SparkSession, sf: str) -> DataFrame:
    documents, settings, tasks = _log_inputs(spark, sf)
    index = spark.createDataFrame(
        [],
        "repo string, path string, lang string, hash string, loc bigint, purpose string, "
        "exports array<struct<name:string,kind:string>>, "
        "routes array<struct<framework:string,method:string,url:string>>, "
        "components array<struct<name:string,props:array<string>,client:boolean,hooks:array<string>>>, "
        "tables array<struct<engine:string,name:string,columns:array<string>>>",
    )
    return bundle.bundles(index, settings, documents, tasks).drop("tokens")


# --- JSON documents ----------------------------------------------------------
_GENERATED = "2024-01-01T00:00:00.000Z"
_FILE_JSON = """'    {' || chr(10)
    || '      "path": "' || path || '",' || chr(10) || '      "hash": "' || hash || '",' || chr(10)
    || '      "lang": "' || lang_name || '",' || chr(10)
    || '      "purpose": ' || coalesce('"' || purpose || '"', 'null') || ',' || chr(10)
    || '      "purposeStale": ' || CASE WHEN stale THEN 'true' ELSE 'false' END || ',' || chr(10)
    || '      "exports": [],' || chr(10) || '      "imports": []' || chr(10) || '    }'
    || CASE WHEN lead(path) OVER (PARTITION BY repo ORDER BY path COLLATE en_us) IS NULL THEN '' ELSE ',' END"""


def _fixed_rows(rows: list[tuple[int, str]]) -> str:
    return union_all([f"SELECT repo, {slot} AS slot, {text} AS text FROM stats" for slot, text in rows])


@query(
    "snapshot_json",
    f"""WITH files AS ({DOC_ROWS}),
        stats AS (SELECT repo, count(*) AS n, sum(len(string_split(content, chr(10)))) AS loc
                  FROM files GROUP BY repo)
        SELECT repo, 11 AS slot, {_FILE_JSON} AS text FROM files UNION ALL """
    + _fixed_rows([
        (0, "'{'"),
        (1, "'  \"schemaVersion\": 1,'"),
        (2, f"'  \"generatedAt\": \"{_GENERATED}\",'"),
        (3, "'  \"root\": \"' || repo || '\",'"),
        (4, "'  \"stack\": [],'"),
        (5, "'  \"stats\": {' || chr(10) || '    \"files\": ' || CAST(n AS STRING) || ',' || chr(10) "
            "|| '    \"indexedFiles\": ' || CAST(n AS STRING) || ',' || chr(10) || '    \"loc\": ' "
            "|| CAST(loc AS STRING) || chr(10) || '  },'"),
        (10, "'  \"files\": ['"), (12, "'  ],'"), (14, "'  \"routes\": [],'"),
        (20, "'  \"components\": [],'"), (30, "'  \"db\": {'"), (40, "'    \"postgres\": [],'"),
        (44, "'    \"prisma\": [],'"), (50, "'    \"mongo\": []'"), (60, "'  }'"), (90, "'}'"),
    ]),
    ("doc_files",),
)
def snapshot_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = export.snapshot_json_rows(doc_index(spark, sf), doc_settings(spark, sf), _GENERATED)
    return rows.select("repo", "slot", "text")


_TASK_JSON = f"""'    {{' || chr(10) || '      "id": "' || id || '",' || chr(10)
    || '      "title": "' || title || '",' || chr(10) || '      "suited": '
    || CASE WHEN is_suited THEN '[' || chr(10) || '        "ui",' || chr(10) || '        "test",'
            || chr(10) || '        "e2e"' || chr(10) || '      ]' ELSE '[]' END || ',' || chr(10)
    || '      "status": "' || status || '",' || chr(10)
    || '      "claimedBy": ' || coalesce('"' || claimed_by || '"', 'null') || ',' || chr(10)
    || '      "notes": "",' || chr(10) || '      "deps": []' || chr(10) || '    }}'
    || CASE WHEN lead(id) OVER (PARTITION BY repo ORDER BY id) IS NULL THEN '' ELSE ',' END"""


@query(
    "bundle_json",
    f"""WITH stats AS (SELECT repo, count(*) AS n FROM task_events GROUP BY repo)
        SELECT repo, 71 AS slot, {_TASK_JSON} AS text FROM ({pc._BOARD}) UNION ALL """
    + _fixed_rows([
        (0, "'{'"),
        (1, "'  \"state\": \"of ' || repo || '\\n\\\"x\\\"\",'"),
        (2, "'  \"handoff\": \"\",'"), (3, "'  \"plan\": \"\",'"), (4, "'  \"decisions\": \"\",'"),
        (5, "'  \"stack\": [' || chr(10) || '    \"react\"' || chr(10) || '  ],'"),
        (14, "'  \"routes\": [],'"), (20, "'  \"components\": [],'"), (30, "'  \"db\": {'"),
        (40, "'    \"postgres\": [],'"), (44, "'    \"prisma\": [],'"), (50, "'    \"mongo\": []'"),
        (60, "'  },'"), (70, "'  \"tasks\": ['"), (72, "'  ]'"), (90, "'}'"),
    ]),
    ("task_events",),
)
def bundle_json(spark: SparkSession, sf: str) -> DataFrame:
    events = d.derive(spark, sf, "task_events")
    tasks = board.fold_board(events, board.added_tasks(events))
    repos = events.select("repo").distinct()
    settings = repos.withColumn("stack", F.array(F.lit("react")))
    none = F.lit(None).cast("string")
    texts = repos.select(
        "repo", F.concat(F.lit("of "), F.col("repo"), F.lit('\n"x"')).alias("state"),
        none.alias("handoff"), none.alias("plan"), none.alias("decisions"),
    )
    index = pc.module_index(spark, sf).filter("false")
    rows = export.bundle_json_rows(index, settings, texts, tasks)
    return rows.select("repo", "slot", "text")


# --- streams -----------------------------------------------------------------
_QUIET = "SELECT repo, ts FROM changes WHERE path LIKE 'src/%'"
_BURSTS = f"""
    SELECT repo, epoch_us(min(ts)) AS first_change, epoch_us(max(ts)) AS last_change, count(*) AS changes
    FROM (SELECT *, sum(starts) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) <= INTERVAL 5 HOUR
                               THEN 0 ELSE 1 END AS starts FROM ({_QUIET})))
    GROUP BY repo, burst"""


def _micros(bursts: DataFrame) -> DataFrame:
    return bursts.select(
        "repo", F.unix_micros("first_change").alias("first_change"),
        F.unix_micros("last_change").alias("last_change"), "changes",
    )


@query("change_bursts", _BURSTS, ("changes",))
def change_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return _micros(ch.bursts(d.derive(spark, sf, "changes"), "5 hours"))


@query(
    "quiet_changes", "SELECT repo, path FROM changes WHERE path LIKE 'src/%'", ("changes",)
)
def quiet_changes(spark: SparkSession, sf: str) -> DataFrame:
    return ch.without_noise(d.derive(spark, sf, "changes")).select("repo", "path")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them; a stream takes a single file only by a pattern."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


@query("streamed_bursts", _BURSTS, ("changes",))
def streamed_bursts(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _stream(spark, sf, "events").createOrReplaceTempView("event_stream")
    changes = spark.sql(d.DERIVED["changes"].replace("FROM events", "FROM event_stream"))
    out, checkpoint = fresh_folder(spark, "bursts"), fresh_folder(spark, "bursts-log")
    ch.stream_bursts(changes, out, checkpoint, gap="5 hours").awaitTermination()
    return _micros(ch.streamed_bursts(spark, out, checkpoint, gap="5 hours"))


@query(
    "streamed_index",
    f"""SELECT repo, path, substring(sha1(content), 1, 8) AS hash,
               len(string_split(content, chr(10))) AS loc
        FROM doc_files WHERE {d.DOC_IS_SOURCE}""",
    ("doc_files",),
)
def streamed_index(spark: SparkSession, sf: str) -> DataFrame:
    settings = doc_settings(spark, sf)
    _stream(spark, sf, "documents").createOrReplaceTempView("document_stream")
    files = spark.sql(d.DERIVED["doc_files"].replace("FROM documents", "FROM document_stream"))
    changes = files.withColumn("ts", F.timestamp_seconds("doc_id"))
    path, checkpoint = fresh_folder(spark, "stream-index"), fresh_folder(spark, "stream-index-log")
    ch.stream_index(changes, path, checkpoint, settings).awaitTermination()
    return ch.current_index(spark, path).select("repo", "path", "hash", "loc")
