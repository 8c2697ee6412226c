"""Checks of sources, path filters, scalars, ignore rules and stacks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.checks import derived as d
from quillmap.checks.catalog import query, union_all
from quillmap.functions import text as t
from quillmap.operators import ignore, stack
from quillmap.operators.extract.registry import extractor_enabled
from quillmap.operators.extract.routes import app_url, below_src, pages_url
from quillmap.plans.storage import fresh_folder
from quillmap.sources import documents as docs
from quillmap.sources.files import _open, read_repo_files, source_files
from quillmap.sources.repo_source import register

TRIM_SET = f"'{fx.JS_WHITESPACE}'"
DIR_SQL = (
    "CASE WHEN contains(path, '/') "
    "THEN left(path, length(path) - position('/' IN reverse(path))) ELSE '.' END"
)


# --- sources -----------------------------------------------------------------
def _tree(spark: SparkSession, sf: str) -> str:
    """A folder with one repository per nation and a file per supplier.

    Tasks write the files themselves: on a local disk Spark's own writer starts a process for each of them.
    """
    root = fresh_folder(spark, "tree")
    lines = d.run_sql(
        spark, sf,
        "SELECT 'org' || CAST(s_nationkey AS STRING) AS org, s_suppkey, coalesce(s_name, '') || chr(10) AS line FROM supplier",
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "org", "s_suppkey")
    files = lines.groupBy("org", "s_suppkey").agg(F.array_join(F.collect_list("line"), "").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                org, key = ("__HIVE_DEFAULT_PARTITION__" if row[c] is None else row[c] for c in ("org", "s_suppkey"))
                folder = f"{top}/org={org}/s_suppkey={key}"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/part-00000.txt") as out:
                    out.write(row["content"].encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["files"])

    files.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    return root


@query(
    "read_repo_files",
    "SELECT 'org' || CAST(s_nationkey AS STRING) AS repo, s_suppkey, s_name || chr(10) AS content "
    "FROM supplier",
)
def read_files(spark: SparkSession, sf: str) -> DataFrame:
    root = _tree(spark, sf)
    orgs = d.run_sql(
        spark, sf, "SELECT DISTINCT 'org' || CAST(s_nationkey AS STRING) AS repo FROM supplier"
    )
    files = read_repo_files(orgs.withColumn("root", F.concat(F.lit(f"{root}/org="), F.col("repo"))))
    key = F.regexp_extract("path", r"^s_suppkey=(\d+)/part-[^/]*\.txt\z", 1)
    return files.filter(key != "").select("repo", key.cast("bigint").alias("s_suppkey"), "content")


@query(
    "read_repo_source",
    "SELECT 'org' || CAST(s_nationkey AS STRING) AS repo, s_suppkey, s_name || chr(10) AS content "
    "FROM supplier WHERE s_nationkey <> 7 AND CAST(s_suppkey AS STRING) LIKE '1%'",
)
def read_source(spark: SparkSession, sf: str) -> DataFrame:
    """Path and repository filters reach the data source."""
    register(spark)
    reader = spark.read.format("repo_files").option("splits", "2")
    root = _tree(spark, sf)
    nations = d.run_sql(spark, sf, "SELECT DISTINCT s_nationkey AS k FROM supplier").collect()  # at most 25
    for n in nations:
        reader = reader.option(f"repo.org{n.k}", f"{root}/org=org{n.k}")
    files = reader.load().filter(
        F.startswith("path", F.lit("s_suppkey=1")) & F.endswith("path", F.lit(".txt")) & (F.col("repo") != "org7")
    )
    key = F.regexp_extract("path", r"^s_suppkey=(\d+)/part-[^/]*\.txt\z", 1)
    return files.filter(key != "").select("repo", key.cast("bigint").alias("s_suppkey"), "content")


@query(
    "front_matter",
    "SELECT repo, turn, split_part(role_line, ':', 2) AS role, '10:20:30' AS at, body FROM ("
    "SELECT 'conv' || CAST(conv_id AS STRING) AS repo, turn, 'role:' || role AS role_line, "
    "text AS body FROM conversations)",
)
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    read = docs.read_markdown(
        d.derive(spark, sf, "conv_documents").withColumn("doc", F.lit("turn"))
    )
    return read.select(
        "repo", F.col("front")["turn"].cast("bigint").alias("turn"),
        F.col("front")["role"].alias("role"), F.col("front")["at"].alias("at"), "body",
    )


@query(
    "config_defaults",
    """SELECT c_name AS repo,
        CASE c_custkey % 4 WHEN 0 THEN CAST('100' || CAST(c_nationkey AS STRING) AS BIGINT)
             ELSE 2000 END AS context_budget,
        CASE c_custkey % 4 WHEN 0 THEN 'user/**|*.user.ts' ELSE '' END AS ignored,
        CAST(CASE c_custkey % 4 WHEN 1 THEN 2 ELSE 5 END AS BIGINT) AS decisions_in_context,
        CASE c_custkey % 4 WHEN 0 THEN 'agent' || CAST(c_custkey AS STRING) END AS agent_name
    FROM customer""",
)
def config_defaults(spark: SparkSession, sf: str) -> DataFrame:
    configs = docs.read_config(d.derive(spark, sf, "customer_configs"))
    return configs.select(
        "repo", "context_budget", F.array_join("ignore", "|").alias("ignored"),
        "decisions_in_context", "agent_name",
    )


_TASK_DOCS = [
    '[{"id": "t-001", "title": "a<<k>>", "suited": ["x", "y"], "status": "open", '
    '"claimedBy": null, "notes": "", "deps": []}, {"id": "t-002", "title": "b", "suited": [], '
    '"status": "done", "claimedBy": "z<<k>>", "notes": "n", "deps": ["t-001"]}]',
    '{"id": "t-001"}',
    "[broken",
    "[]",
]
_TASK_DOC_SQL = d.case_sql(
    "c_custkey % 4",
    {str(i): d.text_sql(x, k=d.as_text("c_custkey")) for i, x in enumerate(_TASK_DOCS)},
)


@query(
    "read_tasks",
    """SELECT c_name AS repo, 't-001' AS id, 'a' || CAST(c_custkey AS STRING) AS title,
              'x|y' AS suited, 'open' AS status, CAST(NULL AS STRING) AS claimed_by, '' AS deps
       FROM customer WHERE c_custkey % 4 = 0
       UNION ALL
       SELECT c_name, 't-002', 'b', '', 'done', 'z' || CAST(c_custkey AS STRING), 't-001'
       FROM customer WHERE c_custkey % 4 = 0""",
)
def read_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = docs.read_tasks(d.run_sql(spark, sf, f"SELECT c_name AS repo, {_TASK_DOC_SQL} AS text FROM customer"))
    return tasks.select(
        "repo", "id", "title", F.array_join("suited", "|").alias("suited"), "status",
        "claimed_by", F.array_join("deps", "|").alias("deps"),
    )


# --- paths and scalars -------------------------------------------------------
@query(
    "source_paths", f"SELECT repo, path FROM doc_files WHERE {d.DOC_IS_SOURCE}", ("doc_files",)
)
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    return source_files(d.derive(spark, sf, "doc_files")).select("repo", "path")


@query(
    "file_languages",
    f"SELECT path, {d.doc_case(1)} AS ext, {d.doc_case(2)} AS lang FROM doc_files",
    ("doc_files",),
)
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    ext = t.extension(F.col("path"))
    return d.derive(spark, sf, "doc_files").select(
        "path", ext.alias("ext"), t.language(ext).alias("lang")
    )


@query("file_hashes", "SELECT doc_id, substring(sha1(text), 1, 8) AS hash FROM documents")
def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return d.derive(spark, sf, "doc_files").select(
        "doc_id", t.short_hash(F.col("content")).alias("hash")
    )


@query("line_counts", "SELECT doc_id, len(string_split(text, chr(10))) AS loc FROM documents")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.derive(spark, sf, "doc_files").select(
        "doc_id", t.line_count(F.col("content")).alias("loc")
    )


@query(
    "token_estimates",
    "SELECT conv_id, turn, CAST(ceil((length(text) + 2 * (turn % 2)) / 4.0) AS BIGINT) AS tokens "
    "FROM conversations",
)
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    astral = F.when(F.col("turn") % 2 == 1, F.lit("\N{GRINNING FACE}")).otherwise("")
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", t.estimate_tokens(F.concat("text", astral)).alias("tokens")
    )


@query("comments_stripped", "SELECT page_id, html || chr(10) AS text FROM pages")
def comments_stripped(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("/* a\n // b */"), F.col("html"), F.lit("/**/\n// tail /* x"))
    return d.table(spark, sf, "pages").select("page_id", t.strip_comments(text).alias("text"))


@query(
    "directory_names",
    f"SELECT path, {DIR_SQL} AS dir, path[length({DIR_SQL}) + 2:] AS name "
    "FROM doc_files WHERE contains(path, '/') "
    "UNION ALL SELECT path, '.', path FROM doc_files WHERE NOT contains(path, '/')",
    ("doc_files",),
)
def directory_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return d.derive(spark, sf, "doc_files").select(
        "path", t.directory(path).alias("dir"), t.base_name(path).alias("name")
    )


@query("path_slashes", "SELECT repo, path FROM doc_files", ("doc_files",))
def path_slashes(spark: SparkSession, sf: str) -> DataFrame:
    back = F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    return d.derive(spark, sf, "doc_files").select("repo", t.forward_slashes(back).alias("path"))


def _web_urls(urgent: str, high: str, medium: str, other: str, p: str, o: str, f: str) -> str:
    key = d.as_text("o_orderkey")
    branch = lambda x: d.text_sql(x, k=key)
    low = d.case_sql("o_orderstatus", {"'P'": branch(p), "'O'": branch(o), "'F'": branch(f)})
    return d.case_sql(
        "o_orderpriority",
        {
            "'1-URGENT'": branch(urgent), "'2-HIGH'": branch(high), "'3-MEDIUM'": branch(medium),
            "'4-NOT SPECIFIED'": branch(other), "'5-LOW'": low,
        },
    )


_APP_URLS = _web_urls(
    "/api/o<<k>>", "/o<<k>>/:id", "/", "/", "/", "/o<<k>>/layout.tsx", "/:[...opt<<k>>]"
)
_PAGES_URLS = _web_urls(
    "/app/api/o<<k>>/route", "/app/(shop)/o<<k>>/:id/page", "/api/o<<k>>/*rest", "/o<<k>>",
    "/_app<<k>>", "/app/o<<k>>/layout", "/app/:[...opt<<k>>]/page",
)


@query(
    "dynamic_segments",
    f"SELECT {d.WEB_PATH} AS path, {_APP_URLS} AS app_url, {_PAGES_URLS} AS pages_url FROM orders",
)
def dynamic_segments(spark: SparkSession, sf: str) -> DataFrame:
    rel = below_src(F.col("path"))
    return d.derive(spark, sf, "web_files").select(
        "path", app_url(rel).alias("app_url"), pages_url(rel).alias("pages_url")
    )


@query(
    "decision_titles",
    f"""SELECT conv_id, turn, CASE WHEN length(text) > 60
            THEN rtrim(left(text, 57), {TRIM_SET}) || '…' ELSE text END AS title
        FROM conversations""",
)
def decision_titles(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", t.decision_title(F.col("text")).alias("title")
    )


@query(
    "client_flags",
    "SELECT 'src/ui/C' || CAST(p_partkey AS STRING) || '.tsx' AS path, "
    "p_type IN ('MEDIUM', 'SMALL') AS client FROM part",
)
def client_flags(spark: SparkSession, sf: str) -> DataFrame:
    return d.derive(spark, sf, "component_files").select(
        "path", t.is_client(F.col("content")).alias("client")
    )


@query(
    "cleaned_answers", f"SELECT conv_id, turn, trim(text, {TRIM_SET}) AS answer FROM conversations"
)
def cleaned_answers(spark: SparkSession, sf: str) -> DataFrame:
    opening = F.when(F.col("role") == "user", "```JSON\n").when(
        F.col("role") == "system", "``` "
    ).otherwise("")
    raw = F.concat(opening, F.col("text"), F.when(opening != "", "\n``` \n").otherwise(" \n"))
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", t.clean_answer(raw).alias("answer")
    )


# --- ignore rules ------------------------------------------------------------
_KEY = d.as_text("s_suppkey")
_KEPT = [
    p for p, hit in zip(d.IGNORE_PATHS, d.IGNORE_HIT, strict=True) if not hit
]


def _supplier_globs(spark: SparkSession, sf: str) -> DataFrame:
    files = d.derive(spark, sf, "ignore_files")
    configs = d.run_sql(
        spark, sf,
        "SELECT s_name AS repo, array('user/**', '*.user.ts') AS ignore FROM supplier"
    )
    return ignore.ignore_globs(files, configs)


@query(
    "ignored_paths_dropped",
    union_all([f"SELECT s_name AS repo, {d.text_sql(p, k=_KEY)} AS path FROM supplier" for p in _KEPT]),
)
def ignored_paths_dropped(spark: SparkSession, sf: str) -> DataFrame:
    rules = ignore.ignore_rules(_supplier_globs(spark, sf))
    return ignore.drop_ignored(d.derive(spark, sf, "ignore_paths"), rules)


@query(
    "ignore_globs",
    union_all([
        f"SELECT s_name AS repo, {d.text_sql(g, k=_KEY)} AS glob FROM supplier"
        for g in ["build<<k>>", "**/logs", "**/*.gen.ts", "deep/**/tmp", "**/a?c.ts",
                  "**/{x,y}.ts", "**/*.py[cod]", "**/[Bb]in", "**/src/{a,b}/**", "**/@(p|q).ts", "user/**", "*.user.ts"]
    ]),
)
def ignore_globs(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier_globs(spark, sf).select("repo", F.explode("globs").alias("glob"))


@query("rejected_globs", "SELECT s_name AS repo, '**/@(p|q).ts' AS glob FROM supplier")
def rejected_globs(spark: SparkSession, sf: str) -> DataFrame:
    return ignore.rejected_globs(_supplier_globs(spark, sf))


# --- stacks and toggles ------------------------------------------------------
@query(
    "mapped_dependencies",
    union_all([
        f"SELECT s_name AS repo, '{dep}' AS dependency, '{owner}' AS stack FROM supplier "
        f"WHERE s_suppkey % 5 = {kind}"
        for kind, dep, owner in [
            (0, "next", "nextjs"), (0, "react", "react"), (1, "express", "express"),
            (1, "mongoose", "mongoose"), (2, "@prisma/client", "prisma"),
            (3, "@supabase/supabase-js", "supabase"), (3, "react-dom", "react"),
        ]
    ]),
)
def mapped_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return stack.mapped_dependencies(d.derive(spark, sf, "manifest_files"))


_KIND = "s_suppkey % 5"


@query(
    "repo_stacks",
    f"""SELECT s_name AS repo,
            CASE {_KIND} WHEN 0 THEN 'app-' || {_KEY} WHEN 1 THEN 'api-' || {_KEY}
                 ELSE 'project' END AS project_name,
            concat_ws(',',
                CASE WHEN {_KIND} = 1 THEN 'express' END,
                CASE WHEN {_KIND} = 1 THEN 'mongoose' END,
                CASE WHEN {_KIND} = 0 OR s_nationkey > 12 THEN 'nextjs' END,
                CASE WHEN {_KIND} = 2 OR s_acctbal > 5000 THEN 'prisma' END,
                CASE WHEN {_KIND} IN (0, 3) THEN 'react' END,
                CASE WHEN {_KIND} = 3 OR s_acctbal < 2000 THEN 'supabase' END) AS stack
        FROM supplier""",
)
def repo_stacks(spark: SparkSession, sf: str) -> DataFrame:
    return stack.repo_stacks(d.derive(spark, sf, "manifest_files")).withColumn(
        "stack", F.array_join("stack", ",")
    )


_EXTRACTOR_NAMES = ["js-ts", "nextjs", "express", "react", "prisma", "sql", "supabase", "mongoose"]


@query(
    "extractor_toggles",
    union_all([
        f"SELECT c_name AS repo, '{n}' AS extractor, "
        f"{'c_custkey % 4 <> 1' if n in ('express', 'sql') else 'true'} AS enabled FROM customer"
        for n in _EXTRACTOR_NAMES
    ]),
)
def extractor_toggles(spark: SparkSession, sf: str) -> DataFrame:
    configs = docs.read_config(d.derive(spark, sf, "customer_configs"))
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("extractor"), extractor_enabled(F.col("extractors"), n).alias("enabled")
        )
        for n in _EXTRACTOR_NAMES
    ])
    return configs.select("repo", F.inline(rows))
