"""Inputs derived from the driver tables, as SQL that Spark and DuckDB both run.

Source files are made up from table columns, so what an extractor should find
in them can be listed from those columns without reading the text again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def text_sql(template: str, **values: str) -> str:
    """SQL that builds ``template`` with ``<<name>>`` replaced by expressions."""
    pieces = []
    for part in re.split(r"(<<\w+>>|')", template):
        if part == "'":
            pieces.append("chr(39)")
        elif part.startswith("<<"):
            pieces.append(values[part[2:-2]])
        elif part:
            pieces.append(f"'{part}'")
    return " || ".join(pieces)


def as_text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def case_sql(on: str, branches: dict[str, str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"CASE {on} {whens}{f' ELSE {otherwise}' if otherwise else ''} END"


# Kinds of document paths: template, extension, language, whether it is source.
DOC_KINDS = [
    ("src/<<l>>/doc_<<k>>.ts", "ts", "ts", True),
    ("lib/d_<<k>>.js", "js", "js", True),
    ("node_modules/pkg/d_<<k>>.js", "js", "js", False),
    ("web/<<l>>/d_<<k>>.min.js", "js", "js", False),
    ("types/d_<<k>>.d.ts", "ts", "ts", False),
    (".hidden/d_<<k>>.ts", "ts", "ts", False),
    ("d_<<k>>.mjs", "mjs", "js", True),
    ("sql/<<l>>/d_<<k>>.sql", "sql", "sql", True),
    ("schema/d_<<k>>.prisma", "prisma", "prisma", True),
    ("docs/d_<<k>>.md", "md", "md", False),
    ("app/dist/d_<<k>>.tsx", "tsx", "tsx", False),
    ("src/.d_<<k>>.ts", "ts", "ts", False),
    ("src/Main_<<k>>.TS", "ts", "ts", False),
    ("src/ui/<<l>>/d_<<k>>.jsx", "jsx", "jsx", True),
    ("pkg.map/d_<<k>>.cjs", "cjs", "js", False),
    ("src/ui/d_<<k>>.tsx", "tsx", "tsx", True),
]
DOC_KIND = f"doc_id % {len(DOC_KINDS)}"
_DOC_PATH = case_sql(
    DOC_KIND,
    {str(i): text_sql(t, k=as_text("doc_id"), l="lang") for i, (t, *_) in enumerate(DOC_KINDS)},
)


def doc_case(column: int) -> str:
    return case_sql(DOC_KIND, {str(i): f"'{kind[column]}'" for i, kind in enumerate(DOC_KINDS)})


DOC_IS_SOURCE = case_sql(
    DOC_KIND, {str(i): str(kind[3]).lower() for i, kind in enumerate(DOC_KINDS)}
)

MODULES = {
    "BUILDING": """import fs from "node:fs";
import { q } from './lib/q<<n>>';
import * as seg from "@seg/building";
import { q2 } from './lib/q<<n>>';
import "./side/<<k>>.css";
const dep = require("pkg-<<n>>");
const p = require('path');
const deep = require( "fs/promises" );
// export const gone_<<k>> = 1;
/* export function hidden_<<k>>() {}
   import z from "zzz"; */
const url = "http://host/<<k>>"; // trailing
export async function load_<<k>>() {}
export const rate_<<k>> = 1;
export let cur_<<k>> = 2;
export type Row_<<k>> = {};
export interface Shape_<<k>> {}
export enum Mode_<<k>> { A }
export class Model_<<k>> {}
export default function Page_<<k>>() {}
export { load_<<k>>, inner as outer_<<k>>, default };
export * from "./re/<<k>>";
export { other } from './o<<n>>';
""",
    "AUTOMOBILE": """'use strict';
const os = require('os');
const a = require("./a<<n>>");
module.exports = function Mgr_<<k>>() {};
module.exports.start_<<k>> = a;
exports.stop_<<k>> = 1;
exports.start_<<k>> = 2;
""",
    "MACHINERY": "\n".join(f'const m{i} = require("./m{i}_<<k>>");' for i in range(1, 18))
    + """
module.exports = { alpha_<<k>>, beta_<<k>>: m1, "quoted": 1, gamma_<<k>> };
""",
    "HOUSEHOLD": """import type { T } from "./t<<n>>";
class Foo_<<k>> {}
module.exports = class Foo_<<k>> {};
exports.Foo_<<k>> = Foo_<<k>>;
export default class {}
""",
    "FURNITURE": """import a, { b } from "./a<<n>>";
export default async function Page_<<k>>() {}
export const enum E_<<k>> { A }
export function* gen_<<k>>() {}
module.exports = require("./r<<n>>");
export type { X };
export { y as z_<<k>>, w };
export const z_<<k>> = 1;
""",
}
_MODULE_TEXT = case_sql(
    "c_mktsegment",
    {
        f"'{seg}'": text_sql(t, k=as_text("c_custkey"), n=as_text("c_nationkey"))
        for seg, t in MODULES.items()
    },
)

SERVER_HEAD = """import express from "express";
const app = express();
const apiRouter = express.Router();
app.get("/health/<<k>>", h);
apiRouter.post('/items/<<k>>', h);
apiRouter.post('/items/<<k>>', h);
axios.get(`/ext/<<k>>`, h);
// app.put("/gone", h);
"""
_SERVER_MOUNTS = case_sql(
    "c_nationkey % 3",
    {
        "0": text_sql('app.use("/api/", apiRouter);\n'),
        "1": text_sql("app.use(\"/api/\", apiRouter);\napp.use('/v2', apiRouter);\n"),
        "2": "''",
    },
)

_ORDER_KEY = as_text("o_orderkey")


def _order(template: str) -> str:
    return text_sql(template, k=_ORDER_KEY)


WEB_PATH = case_sql(
    "o_orderpriority",
    {
        "'1-URGENT'": _order("app/api/o<<k>>/route.ts"),
        "'2-HIGH'": _order("src/app/(shop)/o<<k>>/[id]/page.tsx"),
        "'3-MEDIUM'": _order("pages/api/o<<k>>/[...rest].ts"),
        "'4-NOT SPECIFIED'": _order("src/pages/o<<k>>/index.jsx"),
        "'5-LOW'": case_sql(
            "o_orderstatus",
            {
                "'P'": _order("pages/_app<<k>>.tsx"),
                "'O'": _order("app/o<<k>>/layout.tsx"),
                "'F'": _order("app/[[...opt<<k>>]]/page.jsx"),
            },
        ),
    },
)
_WEB_TEXT = case_sql(
    "o_orderstatus",
    {
        "'P'": _order(
            "export const POST = async () => <<k>>;\nexport async function GET() {}\n"
        ),
        "'O'": _order(
            "export function DELETE() { return <<k>>; }\n// export function PUT() {}\n"
        ),
        "'F'": _order("export const GETTER = <<k>>;\nexport function HEAD() {}\n"),
    },
)

COMPONENTS = {
    "MEDIUM": """"use client";
import { useState } from "react";
export function Card<<k>>({ cartId, size: s, tone = "x", ...rest }: { cartId: string }) {
  const [a, b] = useState(0);
  useEffect(() => {});
  useState(1);
  return <b>{cartId}</b>;
}
""",
    "STANDARD": """export const Plain<<k>> = ({ a }) => <i>{a}</i>;
const Late<<k>>: Kind = async ({ a, b }) => <i>{a}</i>;
""",
    "ECONOMY": """export function Nothing<<k>>() { return 1; }
""",
    "PROMO": """// function Gone<<k>>() {}
export default function Twice<<k>>(props) { return <p/>; }
function Other<<k>>({}) { return <p/>; }
const Twice<<k>> = () => <p/>;
""",
    "LARGE": """export function Wide<<k>>({ one,two }) {
  return (
    1
  );
}
""",
    "SMALL": """import x from "x";
  'use client';
function lower<<k>>() { return <p/>; }
export const Tiny<<k>> = memo(({ a }) => <p/>);
""",
}
_PART_KEY = as_text("p_partkey")
_BRAND = "replace(p_brand, '#', '')"
_SIZE = as_text("p_size")


def _part(template: str) -> str:
    return text_sql(template, k=_PART_KEY, b=_BRAND, s=_SIZE)


_COMPONENT_TEXT = case_sql("p_type", {f"'{t}'": _part(text) for t, text in COMPONENTS.items()})

DDL = """-- part <<k>>
CREATE TABLE IF NOT EXISTS shop.part_<<k>> (
  id uuid PRIMARY KEY DEFAULT gen(1, f(2, 3)),
  price numeric(10, 2),
  "size_<<s>>" int,
  CHECK (price > 0),
  -- lost
  note text
);
create table <<b>> (a int, b text CHECK (b in ("x", "y")));
"""
DEEP_DDL = "create table deep_<<k>> (a int DEFAULT ((((((((((((1)))))))))))), b int);\n"
BROKEN_DDL = "create table broken_<<k>> (id int, (\n"
_DDL_TEXT = _part(DDL) + " || " + case_sql(
    "p_type", {"'PROMO'": _part(DEEP_DDL), "'SMALL'": _part(BROKEN_DDL)}, "''"
)

MODEL = """// models
model Part<<k>> {
  id String @id
  // comment here
  size<<s>> Int?

  @@index([id])
  lonely
  owner Owner @relation(fields: [id])
}
model <<b>> {
  code Int
}
"""
COLLECTION = """import mongoose from "mongoose";
// new Schema({ gone: String });
const Part<<k>>Schema = new mongoose.Schema({
  token: { type: String, enum: ["a", "b"] },
  "size_<<s>>": Number,
  list: [{ x: 1, y: 2 }],
  fn: f(1, { z: 2 }),
  plain,
});
"""
_COLLECTION_TEXT = _part(COLLECTION) + " || " + case_sql(
    "p_type",
    {
        "'PROMO'": _part('export default mongoose.model<Doc>("Part<<k>>", Part<<k>>Schema);\n'),
        "'SMALL'": _part(
            "const Odd<<k>> = new Schema<Doc>({ a: f(\")\"), b: 1, c: g[\"(\"] });\n"
        ),
    },
    "''",
)
TYPED = """export interface Database {
  public: { Tables: {
    <<t>>: {
      Row: { id: string; acct_<<n>>: number | null, }
      Insert: { id: string }
    }
    audit_<<k>>: { Row: { at: string } }
  } }
}
"""
_SUPPLIER = {"k": as_text("s_suppkey"), "n": as_text("s_nationkey")}

# Dependencies of the manifest of each kind of repository.
MANIFESTS = [
    '{"name": "app-<<k>>", "dependencies": {"next": "14", "react": "18"}}',
    '{"name": "api-<<k>>", "dependencies": {"express": "4"}, "devDependencies": {"mongoose": "8"}}',
    '{"name": "", "devDependencies": {"@prisma/client": "5", "lodash": "4"}}',
    '{"dependencies": {"@supabase/supabase-js": "2", "react-dom": "18", "left-pad": "1"}}',
    '{"name": "broken-<<k>>", "dependencies": {"express": "4"}} trailing',
]
MANIFEST_STACKS = ["nextjs,react", "express,mongoose", "prisma", "react,supabase", ""]
MANIFEST_NAMES = ["'app-' || {k}", "'api-' || {k}", "'project'", "'project'", "'project'"]


def manifest_text(kind: str, key: str) -> str:
    return case_sql(kind, {str(i): text_sql(m, k=key) for i, m in enumerate(MANIFESTS)})


IGNORE_LINES = "# made up\n\n/build<<k>>/\nlogs\n*.gen.ts\n!keep.ts\n/deep/**/tmp\na?c.ts\n{x,y}.ts\n*.py[cod]\n[Bb]in/\nsrc/{a,b}/**\n@(p|q).ts\n"
IGNORE_PATHS = [
    "build<<k>>/a.ts", "src/build<<k>>/a.ts", "src/logs/a.ts", "logs.ts", "src/a.gen.ts",
    "keep.ts", "deep/x/y/tmp/a.ts", "deep/tmp", "x/deep/tmp/a.ts", "src/abc.ts", "src/abbc.ts",
    "x.ts", "user/gen/a.ts", "root.user.ts", "src/root.user.ts",
    "m/x.pyc", "m/x.py", "src/Bin/q.ts", "src/a/z.ts", "src/c/z.ts", "p.ts",
]
IGNORE_HIT = [
    True, False, True, False, True, False, True, True, False, True, False, True, True, True, False,
    True, False, True, True, False, False,
]

_CONV_TS = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '7' HOUR * turn"
_FIRST_LINE = "split_part(text, chr(10), 1)"

TASK_ACTIONS = {
    "'signup'": "'add'", "'view'": "'add'", "'purchase'": "'claim'", "'click'": "'claim'",
    "'error'": "'done'",
}
_TASK_NUMBER = "1 + event_id % 40"

INDEX_OK = (
    '{"schemaVersion": 1, "generatedAt": "2024-01-01", "root": "r<<k>>", "stack": [], '
    '"stats": {"files": 1, "indexedFiles": 1, "loc": <<k>>}, "routes": [], "components": [], '
    '"db": {"postgres": [], "prisma": [], "mongo": []}, '
    '"files": [{"path": "a<<k>>.ts", "hash": "h<<k>>", "lang": "ts", "purpose": "p<<k>>", '
    '"purposeStale": true, "exports": [{"name": "x", "kind": "const"}], "imports": ["y"]}]}'
)
INDEX_DOCUMENTS = [
    INDEX_OK,
    "[<<k>>]",
    '{"schemaVersion": "1", "generatedAt": 5, "root": null}',
    '{"schemaVersion": 2, "generatedAt": "g", "root": "r", "stack": {}, "stats": [], '
    '"routes": [], "components": [], "db": [], "files": [7, {"path": <<k>>, "hash": "h", '
    '"exports": []}]}',
    "{not json <<k>>",
    "{'schemaVersion': 1}",
    INDEX_OK + " x",
]
INDEX_PROBLEMS = [
    [],
    ["index is not an object"],
    [
        "schemaVersion mismatch: expected 1, got 1", "generatedAt must be a string",
        "root must be a string", "stack must be an array", "files must be an array",
        "routes must be an array", "components must be an array", "db must be an object",
        "stats must be an object",
    ],
    [
        "schemaVersion mismatch: expected 1, got 2", "stack must be an array",
        "db must be an object", "stats must be an object", "files[0] is not an object",
        "files[1].path must be a string", "files[1].imports must be an array",
    ],
    ["index is not valid JSON"],
    ["index is not valid JSON"],
    ["index is not valid JSON"],
]

CONFIGS = [
    '{"contextBudget": 100<<n>>, "ignore": ["user/**", "*.user.ts"], "agentName": "agent<<k>>"}',
    '{"extractors": {"express": false, "react": true, "sql": false}, "decisionsInContext": 2}',
    "{broken",
    "{}",
]


def config_text(kind: str, key: str, nation: str) -> str:
    return case_sql(
        kind, {str(i): text_sql(c, k=key, n=nation) for i, c in enumerate(CONFIGS)}
    )


def _variants(column: str, templates: list[str], **values: str) -> str:
    return case_sql(column, {str(i): text_sql(t, **values) for i, t in enumerate(templates)})


ORG = "'org' || CAST({} AS STRING)"

DERIVED: dict[str, str] = {
    "doc_files": f"""
        SELECT source AS repo, {_DOC_PATH} AS path, text AS content, doc_id, lang, n_chars
        FROM documents""",
    "module_files": f"""
        SELECT {ORG.format('c_nationkey')} AS repo,
               'src/mods/m' || {as_text('c_custkey')} || '.ts' AS path, {_MODULE_TEXT} AS content
        FROM customer""",
    "server_files": f"""
        SELECT {ORG.format('c_nationkey')} AS repo,
               'src/servers/s' || {as_text('c_custkey')} || '.js' AS path,
               {text_sql(SERVER_HEAD, k=as_text('c_custkey'))} || {_SERVER_MOUNTS} AS content
        FROM customer""",
    "web_files": f"""
        SELECT {ORG.format('o_custkey % 25')} AS repo, {WEB_PATH} AS path, {_WEB_TEXT} AS content
        FROM orders""",
    "component_files": f"""
        SELECT {ORG.format('p_partkey % 25')} AS repo,
               'src/ui/C' || {_PART_KEY} || '.tsx' AS path, {_COMPONENT_TEXT} AS content
        FROM part""",
    "ddl_files": f"""
        SELECT {ORG.format('p_partkey % 25')} AS repo,
               'db/p' || {_PART_KEY} || '.sql' AS path, {_DDL_TEXT} AS content
        FROM part""",
    "model_files": f"""
        SELECT {ORG.format('p_partkey % 25')} AS repo,
               'models/p' || {_PART_KEY} || '.prisma' AS path, {_part(MODEL)} AS content
        FROM part""",
    "collection_files": f"""
        SELECT {ORG.format('p_partkey % 25')} AS repo,
               'src/store/p' || {_PART_KEY} || '.ts' AS path, {_COLLECTION_TEXT} AS content
        FROM part""",
    "typed_files": f"""
        SELECT {ORG.format('s_nationkey')} AS repo,
               'src/supabase/types' || {as_text('s_suppkey')} || '.ts' AS path,
               {text_sql(TYPED, t="lower(replace(s_name, '#', '_'))", **_SUPPLIER)} AS content
        FROM supplier""",
    "manifest_files": f"""
        SELECT s_name AS repo, 'package.json' AS path,
               {manifest_text('s_suppkey % 5', as_text('s_suppkey'))} AS content
        FROM supplier
        UNION ALL
        SELECT s_name, 'prisma/schema.prisma', '' FROM supplier WHERE s_acctbal > 5000
        UNION ALL
        SELECT s_name, 'supabase/seed.sql', '' FROM supplier WHERE s_acctbal < 2000
        UNION ALL
        SELECT s_name, 'next.config.mjs', '' FROM supplier WHERE s_nationkey > 12""",
    "org_manifests": f"""
        SELECT {ORG.format('n_nationkey')} AS repo, 'package.json' AS path,
               {manifest_text('n_nationkey % 5', as_text('n_nationkey'))} AS content
        FROM nation""",
    "org_configs": f"""
        SELECT {ORG.format('n_nationkey')} AS repo,
               {config_text('n_nationkey % 4', as_text('n_nationkey'), as_text('n_nationkey'))} AS text
        FROM nation""",
    "customer_configs": f"""
        SELECT c_name AS repo,
               {config_text('c_custkey % 4', as_text('c_custkey'), as_text('c_nationkey'))} AS text
        FROM customer""",
    "ignore_files": f"""
        SELECT s_name AS repo, '.gitignore' AS path,
               {text_sql(IGNORE_LINES, k=as_text('s_suppkey'))} AS content
        FROM supplier""",
    "ignore_paths": "\nUNION ALL\n".join(
        f"SELECT s_name AS repo, {text_sql(p, k=as_text('s_suppkey'))} AS path FROM supplier"
        for p in IGNORE_PATHS
    ),
    "snapshot_prev": f"""
        SELECT d.source AS repo,
               CASE WHEN l.quality = 0 THEN 'old/' || d.path ELSE d.path END AS path,
               substring(CASE WHEN l.toxic = 1 THEN sha1(d.content || 'x') ELSE sha1(d.content) END, 1, 8)
                   AS hash,
               CASE WHEN d.n_chars > 300 THEN 'about ' || {as_text('d.doc_id')} END AS purpose,
               d.n_chars > 2000 AS purpose_stale
        FROM (SELECT doc_id, source, {_DOC_PATH} AS path, text AS content, n_chars FROM documents) d
        JOIN labels l ON l.doc_id = d.doc_id""",
    "conv_sections": f"""
        SELECT 'conv' || {as_text('conv_id')} AS repo, CAST(turn AS INT) AS priority,
               'turn' || {as_text('turn')} AS name, text AS body, {_FIRST_LINE} AS collapsed
        FROM conversations""",
    "handoffs": f"""
        SELECT 'conv' || {as_text('conv_id')} AS repo, {_CONV_TS} AS ts, turn AS seq,
               CASE WHEN turn % 2 = 1 THEN 'agent' || {as_text('turn')} ELSE '' END AS from_agent,
               text AS stopped, {_FIRST_LINE} AS next,
               CASE WHEN length(text) > 500 THEN 'long' ELSE '' END AS gotchas,
               CAST(NULL AS STRING) AS files
        FROM conversations WHERE role = 'assistant'""",
    "decisions": f"""
        SELECT 'conv' || {as_text('conv_id')} AS repo, {_CONV_TS} AS ts, turn AS seq, text
        FROM conversations WHERE role = 'user'""",
    "state_documents": f"""
        SELECT DISTINCT 'conv' || {as_text('conv_id')} AS repo, 'state' AS doc,
               '---' || chr(10) || 'updated: 2023-12-31T10:11:12.000Z' || chr(10)
               || 'lastAgent: nobody' || chr(10) || 'phase: setup: one' || chr(10) || '---' || chr(10)
               || chr(10) || '# State of ' || {as_text('conv_id')} || chr(10) AS text
        FROM conversations""",
    "conv_documents": f"""
        SELECT 'conv' || {as_text('conv_id')} AS repo, turn,
               '---' || chr(10) || 'turn: ' || {as_text('turn')} || chr(10) || 'role:  ' || role
               || chr(10) || 'at: 10:20:30' || chr(10) || '---' || chr(10) || text AS text
        FROM conversations""",
    "task_events": f"""
        SELECT 'user' || {as_text('user_id')} AS repo, event_id AS seq, ts,
               {case_sql('event_type', TASK_ACTIONS)} AS action,
               CASE WHEN event_type NOT IN ('signup', 'view')
                    THEN 't-' || lpad({as_text(_TASK_NUMBER)}, 3, '0') END AS task_id,
               'task ' || {as_text('event_id')} AS title,
               CASE WHEN event_type = 'view' THEN 'ui, test ,,e2e' END AS suited,
               CASE WHEN value > 10 THEN 'agent' || {as_text('event_id % 5')} END AS by
        FROM events""",
    "changes": f"""
        SELECT 'user' || {as_text('user_id')} AS repo, CAST(ts AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'error' THEN 'node_modules/x.js'
                               WHEN 'view' THEN '.github/y.yml'
                               WHEN 'signup' THEN NULL
                               ELSE 'src/f' || {as_text('event_id')} || '.ts' END AS path
        FROM events""",
    "index_documents": f"""
        SELECT s_name AS repo,
               {_variants(f's_suppkey % {len(INDEX_DOCUMENTS)}', INDEX_DOCUMENTS, k=as_text('s_suppkey'))}
                   AS value
        FROM supplier""",
    "answers": f"""
        SELECT source AS repo, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * doc_id AS ts,
               CASE WHEN lang = 'fr' THEN 'sorry'
                    WHEN lang = 'de' THEN text ELSE '' END AS noise,
               {_DOC_PATH} AS path, doc_id, lang
        FROM documents""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register driver tables as views; times are UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the driver tables it names."""
    words = set(re.findall(r"\w+", sql))
    load(spark, sf_dir, *[t for t in TABLES if t in words])
    return spark.sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, DERIVED[name])
