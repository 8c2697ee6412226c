"""Checks of everything that is extracted from file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.checks import derived as d
from quillmap.checks.catalog import query, union_all
from quillmap.functions.brackets import split_top_level
from quillmap.functions.text import strip_comments
from quillmap.operators import tables
from quillmap.operators.extract import components as comp
from quillmap.operators.extract import modules as mod
from quillmap.operators.extract import routes as rt
from quillmap.operators.extract import schemas as sch
from quillmap.operators.extract.base import FileColumns
from quillmap.operators.extract.registry import BUILT_IN, apply_gates, extract_ungated
from quillmap.plans.index import repo_settings
from quillmap.sources.files import source_files

_CUST = {"k": d.as_text("c_custkey"), "n": d.as_text("c_nationkey")}
_MODULE_PATH = "'src/mods/m' || CAST(c_custkey AS STRING) || '.ts'"


def _clean(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return d.derive(spark, sf, name).select(
        "repo", "path", F.col("content").alias("raw"), strip_comments(F.col("content")).alias("clean")
    )


def _names(rows: dict[str, list[str]], column: str) -> str:
    return union_all([
        f"SELECT {_MODULE_PATH} AS path, {i} AS pos, {d.text_sql(name, **_CUST)} AS {column} "
        f"FROM customer WHERE c_mktsegment = '{seg}'"
        for seg, names in rows.items()
        for i, name in enumerate(names)
    ])


def _symbols(rows: dict[str, list[tuple[str, str]]]) -> str:
    return union_all([
        f"SELECT {_MODULE_PATH} AS path, {i} AS pos, {d.text_sql(name, **_CUST)} AS name, "
        f"'{kind}' AS kind FROM customer WHERE c_mktsegment = '{seg}'"
        for seg, symbols in rows.items()
        for i, (name, kind) in enumerate(symbols)
    ])


def _explode_symbols(spark: SparkSession, sf: str, build) -> DataFrame:
    rows = _clean(spark, sf, "module_files").select(
        "path", F.posexplode(build(F.col("clean"))).alias("pos", "s")
    )
    return rows.select("path", "pos", "s.name", "s.kind")


# --- modules -----------------------------------------------------------------
RAW_IMPORTS = {
    "BUILDING": [
        "node:fs", "./lib/q<<n>>", "@seg/building", "./lib/q<<n>>", "./side/<<k>>.css",
        "pkg-<<n>>", "path", "fs/promises", "./re/<<k>>", "./o<<n>>",
    ],
    "AUTOMOBILE": ["os", "./a<<n>>"],
    "MACHINERY": [f"./m{i}_<<k>>" for i in range(1, 18)],
    "HOUSEHOLD": ["./t<<n>>"],
    "FURNITURE": ["./a<<n>>", "./r<<n>>"],
}
IMPORTS = {
    "BUILDING": [
        "./lib/q<<n>>", "@seg/building", "./side/<<k>>.css", "pkg-<<n>>", "fs/promises",
        "./re/<<k>>", "./o<<n>>",
    ],
    "AUTOMOBILE": ["./a<<n>>"],
    "MACHINERY": [f"./m{i}_<<k>>" for i in range(1, 16)],
    "HOUSEHOLD": ["./t<<n>>"],
    "FURNITURE": ["./a<<n>>", "./r<<n>>"],
}
DECLARED = {
    "BUILDING": [
        ("load_<<k>>", "function"), ("rate_<<k>>", "const"), ("cur_<<k>>", "const"),
        ("Row_<<k>>", "type"), ("Shape_<<k>>", "interface"), ("Mode_<<k>>", "enum"),
        ("Model_<<k>>", "class"),
    ],
    "FURNITURE": [("enum", "const"), ("gen_<<k>>", "function"), ("z_<<k>>", "const")],
}
DEFAULTS = {
    "BUILDING": [("Page_<<k>>", "default")],
    "HOUSEHOLD": [("default", "default")],
    "FURNITURE": [("async", "default")],
}
BRACES = {
    "BUILDING": [("load_<<k>>", "const"), ("outer_<<k>>", "const"), ("other", "const")],
    "FURNITURE": [("z_<<k>>", "const"), ("w", "const")],
}
ASSIGNED = {
    "AUTOMOBILE": [("Mgr_<<k>>", "function")],
    "HOUSEHOLD": [("Foo_<<k>>", "class")],
    "FURNITURE": [("require", "default")],
}
OBJECT_KEYS = {
    "MACHINERY": [("alpha_<<k>>", "const"), ("beta_<<k>>", "const"), ("gamma_<<k>>", "const")],
}
PROPERTIES = {
    "AUTOMOBILE": [("start_<<k>>", "const"), ("stop_<<k>>", "const"), ("start_<<k>>", "const")],
    "HOUSEHOLD": [("Foo_<<k>>", "const")],
}
EXPORTS = {
    "BUILDING": [*DECLARED["BUILDING"], *DEFAULTS["BUILDING"], *BRACES["BUILDING"][1:]],
    "AUTOMOBILE": [*ASSIGNED["AUTOMOBILE"], *PROPERTIES["AUTOMOBILE"][:2]],
    "MACHINERY": OBJECT_KEYS["MACHINERY"],
    "HOUSEHOLD": [*DEFAULTS["HOUSEHOLD"], *ASSIGNED["HOUSEHOLD"]],
    "FURNITURE": [
        *DECLARED["FURNITURE"], *DEFAULTS["FURNITURE"], *BRACES["FURNITURE"][1:],
        *ASSIGNED["FURNITURE"],
    ],
}


@query("import_specifiers", _names(RAW_IMPORTS, "specifier"))
def import_specifiers(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf, "module_files").select(
        "path", F.posexplode(mod.import_specifiers(F.col("clean"))).alias("pos", "specifier")
    )


@query("normalized_imports", _names(IMPORTS, "specifier"))
def normalized_imports(spark: SparkSession, sf: str) -> DataFrame:
    found = mod.normalize_imports(mod.import_specifiers(F.col("clean")))
    return _clean(spark, sf, "module_files").select(
        "path", F.posexplode(found).alias("pos", "specifier")
    )


for _name, _rows, _build in [
    ("declared_exports", DECLARED, mod.declared_exports),
    ("default_exports", DEFAULTS, mod.default_exports),
    ("brace_exports", BRACES, mod.brace_exports),
    ("commonjs_assignments", ASSIGNED, mod.commonjs_assignment),
    ("commonjs_object_keys", OBJECT_KEYS, mod.commonjs_object_keys),
    ("commonjs_properties", PROPERTIES, mod.commonjs_properties),
    ("exported_symbols", EXPORTS, mod.exported_symbols),
]:
    query(_name, _symbols(_rows))(
        lambda spark, sf, build=_build: _explode_symbols(spark, sf, build)
    )


# --- routes ------------------------------------------------------------------
_ORDER = {"k": d.as_text("o_orderkey")}
_VERBS = {"P": ["GET", "POST"], "O": ["DELETE"], "F": ["HEAD"]}


def _web_route(where: str, method: str, url: str) -> str:
    return (
        f"SELECT o_custkey % 25 AS org, {d.WEB_PATH} AS file, 'nextjs' AS framework, "
        f"'{method}' AS method, {d.text_sql(url, **_ORDER)} AS path FROM orders WHERE {where}"
    )


WEB_ROUTES = union_all(
    [
        _web_route(f"o_orderpriority = '1-URGENT' AND o_orderstatus = '{s}'", v, "/api/o<<k>>")
        for s, verbs in _VERBS.items()
        for v in verbs
    ]
    + [
        _web_route("o_orderpriority = '2-HIGH'", "GET", "/o<<k>>/:id"),
        _web_route("o_orderpriority = '3-MEDIUM'", "ALL", "/api/o<<k>>/*rest"),
        _web_route("o_orderpriority = '4-NOT SPECIFIED'", "GET", "/o<<k>>"),
        _web_route("o_orderpriority = '5-LOW' AND o_orderstatus = 'F'", "GET", "/:[...opt<<k>>]"),
    ]
)


def _exploded_routes(spark: SparkSession, sf: str, name: str, routes: Column) -> DataFrame:
    rows = _clean(spark, sf, name).select(F.col("path").alias("file"), F.explode(routes).alias("r"))
    return rows.select("file", "r.framework", "r.method", F.col("r.url").alias("path"))


@query("file_routes", f"SELECT file, framework, method, path FROM ({WEB_ROUTES})")
def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    routes = rt.file_routes(F.col("path"), F.col("clean"))
    return _exploded_routes(spark, sf, "web_files", routes)


@query(
    "exported_verbs",
    union_all([
        f"SELECT {d.WEB_PATH} AS file, '{v}' AS verb FROM orders WHERE o_orderstatus = '{s}'"
        for s, verbs in _VERBS.items()
        for v in verbs
    ]),
)
def exported_verbs(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf, "web_files").select(
        F.col("path").alias("file"), F.explode(rt.exported_verbs(F.col("clean"))).alias("verb")
    )


def _call_route(method: str, url: str) -> str:
    return (
        f"SELECT c_nationkey AS org, 'src/servers/s' || CAST(c_custkey AS STRING) || '.js' AS file, "
        f"'express' AS framework, '{method}' AS method, {url} AS path FROM customer"
    )


_ITEMS = "CASE WHEN c_nationkey % 3 = 0 THEN '/api' ELSE '' END || " + d.text_sql("/items/<<k>>", **_CUST)
CALL_ROUTES = [
    _call_route("GET", d.text_sql("/health/<<k>>", **_CUST)),
    _call_route("POST", _ITEMS),
    _call_route("GET", d.text_sql("/ext/<<k>>", **_CUST)),
]


@query(
    "call_routes",
    f"SELECT file, framework, method, path FROM ({union_all([*CALL_ROUTES, CALL_ROUTES[1]])})",
)
def call_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded_routes(spark, sf, "server_files", rt.call_routes(F.col("clean")))


@query(
    "distinct_routes", f"SELECT file, framework, method, path FROM ({union_all(CALL_ROUTES)})"
)
def distinct_routes(spark: SparkSession, sf: str) -> DataFrame:
    routes = F.array_distinct(rt.call_routes(F.col("clean")))
    return _exploded_routes(spark, sf, "server_files", routes)


# --- components --------------------------------------------------------------
_PART = {"k": d.as_text("p_partkey"), "b": "replace(p_brand, '#', '')", "s": d.as_text("p_size")}
_COMPONENT_PATH = "'src/ui/C' || CAST(p_partkey AS STRING) || '.tsx'"
COMPONENTS = [
    ("MEDIUM", 0, "Card<<k>>", "cartId|size|tone|rest", True, "useEffect|useState"),
    ("STANDARD", 0, "Plain<<k>>", "", False, None),
    ("STANDARD", 1, "Late<<k>>", "a|b", False, None),
    ("PROMO", 0, "Twice<<k>>", "", False, None),
    ("PROMO", 1, "Other<<k>>", "", False, None),
    ("LARGE", 0, "Wide<<k>>", "one|two", False, None),
    ("SMALL", 0, "Tiny<<k>>", "", True, None),
]
COMPONENT_ROWS = union_all([
    f"SELECT p_partkey % 25 AS org, {_COMPONENT_PATH} AS file, {pos} AS pos, "
    f"{d.text_sql(name, **_PART)} AS name, '{props}' AS props, {str(client).lower()} AS client, "
    f"CAST({'NULL' if hooks is None else repr(hooks)} AS STRING) AS hooks "
    f"FROM part WHERE p_type = '{kind}'"
    for kind, pos, name, props, client, hooks in COMPONENTS
])


def _show_components(rows: DataFrame) -> DataFrame:
    return rows.withColumn("props", F.array_join("props", "|")).withColumn(
        "hooks", F.array_join("hooks", "|")
    )


@query("components", f"SELECT file, pos, name, props, client, hooks FROM ({COMPONENT_ROWS})")
def components(spark: SparkSession, sf: str) -> DataFrame:
    found = comp.components(F.col("raw"), F.col("clean"))
    rows = _clean(spark, sf, "component_files").select(
        F.col("path").alias("file"), F.posexplode(found).alias("pos", "c")
    )
    return _show_components(rows.select("file", "pos", "c.*"))


@query(
    "component_props",
    union_all([
        f"SELECT c_custkey, {i} AS pos, {name} AS prop FROM customer"
        for i, name in enumerate(["lower(c_mktsegment)", "'b'", "'d'", "'rest'"])
    ]),
)
def component_props(spark: SparkSession, sf: str) -> DataFrame:
    parameter = F.concat(
        F.lit(" { "), F.lower("c_mktsegment"), F.lit(": x, b = 1, 5, , d, ...rest }: Props")
    )
    return d.table(spark, sf, "customer").select(
        "c_custkey", F.posexplode(comp.prop_names(parameter)).alias("pos", "prop")
    )


@query(
    "component_hooks",
    f"""SELECT {_COMPONENT_PATH} AS file, h AS hook FROM part,
        (SELECT unnest(['useEffect', 'useState']) AS h) WHERE p_type = 'MEDIUM'""",
)
def component_hooks(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf, "component_files").select(
        F.col("path").alias("file"), F.explode(comp.hook_names(F.col("clean"))).alias("hook")
    )


# --- tables ------------------------------------------------------------------
def _table_rows(table: str, key: dict[str, str], org: str, path: str, rows: list[tuple]) -> str:
    return union_all([
        f"SELECT {org} AS org, {path} AS source, '{engine}' AS engine, {pos} AS pos, "
        f"{d.text_sql(name, **key)} AS name, {d.text_sql(columns, **key) or chr(39) * 2} AS columns "
        f"FROM {table} WHERE {where}"
        for engine, pos, name, columns, where in rows
    ])


DDL_ROWS = _table_rows(
    "part", _PART, "p_partkey % 25", "'db/p' || CAST(p_partkey AS STRING) || '.sql'",
    [
        ("postgres", 0, "part_<<k>>", "id|price|size_<<s>>", "true"),
        ("postgres", 1, "<<b>>", "a|b", "true"),
        ("postgres", 2, "deep_<<k>>", "a|b", "p_type = 'PROMO'"),
        ("postgres", 2, "broken_<<k>>", "", "p_type = 'SMALL'"),
    ],
)
MODEL_ROWS = _table_rows(
    "part", _PART, "p_partkey % 25", "'models/p' || CAST(p_partkey AS STRING) || '.prisma'",
    [
        ("prisma", 0, "Part<<k>>", "id|size<<s>>|owner", "true"),
        ("prisma", 1, "<<b>>", "code", "true"),
    ],
)
_FIELDS = "token|size_<<s>>|list|fn"
COLLECTION_ROWS = _table_rows(
    "part", _PART, "p_partkey % 25", "'src/store/p' || CAST(p_partkey AS STRING) || '.ts'",
    [
        ("mongo", 0, "Part<<k>>", _FIELDS, "p_type = 'PROMO'"),
        ("mongo", 0, "Part<<k>>Schema", _FIELDS, "p_type <> 'PROMO'"),
        ("mongo", 1, "Part<<k>>Schema", "a", "p_type = 'SMALL'"),
    ],
)
TYPED_ROWS = _table_rows(
    "supplier",
    {"k": d.as_text("s_suppkey"), "n": d.as_text("s_nationkey"), "t": "lower(replace(s_name, '#', '_'))"},
    "s_nationkey", "'src/supabase/types' || CAST(s_suppkey AS STRING) || '.ts'",
    [
        ("postgres", 0, "<<t>>", "id|acct_<<n>>", "true"),
        ("postgres", 1, "audit_<<k>>", "at", "true"),
    ],
)


def _show_tables(rows: DataFrame) -> DataFrame:
    return rows.withColumn("columns", F.array_join("columns", "|"))


def _exploded_tables(spark: SparkSession, sf: str, name: str, found: Column) -> DataFrame:
    rows = _clean(spark, sf, name).select(
        F.col("path").alias("source"), F.posexplode(found).alias("pos", "t")
    )
    return _show_tables(rows.select("source", "pos", "t.*"))


for _name, _rows, _input, _found in [
    ("ddl_tables", DDL_ROWS, "ddl_files", lambda: sch.ddl_tables(F.col("raw"))),
    ("schema_models", MODEL_ROWS, "model_files", lambda: sch.models(F.col("raw"))),
    ("document_collections", COLLECTION_ROWS, "collection_files", lambda: sch.collections(F.col("clean"))),
    ("typed_tables", TYPED_ROWS, "typed_files", lambda: sch.typed_tables(F.col("raw"))),
]:
    query(_name, f"SELECT source, pos, engine, name, columns FROM ({_rows})")(
        lambda spark, sf, name=_input, found=_found: _exploded_tables(spark, sf, name, found())
    )

_BODY_1 = d.DDL.split("part_<<k>> (", 1)[1].split("\n);", 1)[0] + "\n"
_BODY_2 = d.DDL.split("<<b>> (", 1)[1].split(");", 1)[0]
_BODY_DEEP = d.DEEP_DDL.split("deep_<<k>> (", 1)[1].split(");", 1)[0]
_DDL_PATH = "'db/p' || CAST(p_partkey AS STRING) || '.sql'"


def _bodies(value: str) -> str:
    return union_all([
        f"SELECT {_DDL_PATH} AS path, {pos} AS pos, {text if value == 'body' else parts} AS {value} "
        f"FROM part WHERE {where}"
        for pos, text, parts, where in [
            (0, d.text_sql(_BODY_1, **_PART), 5, "true"),
            (1, d.text_sql(_BODY_2, **_PART), 2, "true"),
            (2, d.text_sql(_BODY_DEEP, **_PART), 2, "p_type = 'PROMO'"),
            (2, "''", 1, "p_type = 'SMALL'"),
        ]
    ])


@query("balanced_spans", _bodies("body"))
def balanced_spans(spark: SparkSession, sf: str) -> DataFrame:
    return d.derive(spark, sf, "ddl_files").select(
        "path", F.posexplode(sch.ddl_bodies(F.col("content"))).alias("pos", "body")
    )


@query("top_level_parts", _bodies("parts"))
def top_level_parts(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_spans(spark, sf).select(
        "path", "pos", F.size(split_top_level(F.col("body"), "(", ")")).alias("parts")
    )


@query(
    "ddl_columns",
    f"""SELECT source AS path, pos, unnest(string_split(columns, '|')) AS column_name
        FROM ({DDL_ROWS}) WHERE columns <> ''""",
)
def ddl_columns(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_spans(spark, sf).select(
        "path", "pos", F.explode(sch.ddl_columns(F.col("body"))).alias("column_name")
    )


# --- gates, unions, extension ------------------------------------------------
CODE_INPUTS = [
    "module_files", "server_files", "web_files", "component_files", "ddl_files", "model_files",
    "collection_files", "typed_files",
]


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """All made-up source files of all organisations, with a manifest for each."""
    parts = [*CODE_INPUTS, "org_manifests"]
    files = d.run_sql(
        spark, sf, union_all([f"SELECT repo, path, content FROM ({d.DERIVED[p]})" for p in parts])
    )
    # The sample tables are one small file each. Spread them only where the
    # input has fewer splits than there are cores to use.
    cores = spark.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < 4 * cores else files


def org_settings(spark: SparkSession, sf: str) -> DataFrame:
    return repo_settings(
        d.derive(spark, sf, "org_manifests"), d.derive(spark, sf, "org_configs")
    )


HAS = {
    "nextjs": "org % 5 = 0",
    "react": "org % 5 IN (0, 3)",
    "express": "org % 5 = 1 AND org % 4 <> 1",
    "mongoose": "org % 5 = 1",
    "supabase": "org % 5 = 3",
    "sql": "org % 4 <> 1",
}


def gated(rows: str, extractor: str, columns: str) -> str:
    condition = HAS.get(extractor, "true")
    return f"SELECT 'org' || CAST(org AS STRING) AS repo, {columns} FROM ({rows}) WHERE {condition}"


_ROUTE_COLUMNS = "file, framework, method, path"
GATED_ROUTES = union_all([
    gated(WEB_ROUTES, "nextjs", _ROUTE_COLUMNS),
    gated(union_all(CALL_ROUTES), "express", _ROUTE_COLUMNS),
])
_TABLE_COLUMNS = "source, engine, pos, name, columns"
GATED_TABLES = union_all([
    gated(DDL_ROWS, "sql", _TABLE_COLUMNS),
    gated(MODEL_ROWS, "prisma", _TABLE_COLUMNS),
    gated(COLLECTION_ROWS, "mongoose", _TABLE_COLUMNS),
    gated(TYPED_ROWS, "supabase", _TABLE_COLUMNS),
])
GATED_COMPONENTS = gated(COMPONENT_ROWS, "react", "file, name, props, client, hooks")


def gated_index(spark: SparkSession, sf: str) -> DataFrame:
    return apply_gates(extract_ungated(source_files(code_files(spark, sf))), org_settings(spark, sf))


@query("gated_routes", GATED_ROUTES)
def gated_routes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.routes(gated_index(spark, sf)).drop("pos")


@query("gated_tables", GATED_TABLES)
def gated_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _show_tables(tables.db_tables(gated_index(spark, sf)))


@query("gated_components", GATED_COMPONENTS)
def gated_components(spark: SparkSession, sf: str) -> DataFrame:
    return _show_components(tables.components(gated_index(spark, sf))).drop("pos")


@query(
    "contribution_sizes",
    f"""SELECT 'routes' AS list, count(*) AS entries FROM ({GATED_ROUTES})
        UNION ALL SELECT 'tables', count(*) FROM ({GATED_TABLES})
        UNION ALL SELECT 'components', count(*) FROM ({GATED_COMPONENTS})""",
)
def contribution_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = gated_index(spark, sf).select(
        *[F.size(k).alias(k) for k in ("routes", "tables", "components")]
    )
    totals = sizes.agg(*[F.sum(k).alias(k) for k in sizes.columns])
    pairs = F.array(*[F.struct(F.lit(k).alias("list"), F.col(k).alias("entries")) for k in totals.columns])
    return totals.select(F.inline(pairs))


class MountExtractor:
    """An extractor as a user would add one: mount points as routes."""

    name = "mounts"
    stacks: tuple[str, ...] = ()

    def applies(self, file: FileColumns) -> Column:
        return file.ext == "js"

    def lists(self, file: FileColumns) -> dict[str, Column]:
        from quillmap import fixed_values as fx
        from quillmap.functions.arrays import find_all

        def route(url: Column) -> Column:
            return F.struct(
                F.lit("mounts").alias("framework"), F.lit("USE").alias("method"), url.alias("url")
            )

        return {"routes": F.transform(find_all(file.clean, fx.MOUNT_CALL, 2), route)}


@query(
    "added_extractor",
    f"""SELECT 'src/servers/s' || CAST(c_custkey AS STRING) || '.js' AS file, '/api/' AS path
        FROM customer WHERE c_nationkey % 3 < 2
        UNION ALL
        SELECT 'src/servers/s' || CAST(c_custkey AS STRING) || '.js', '/v2'
        FROM customer WHERE c_nationkey % 3 = 1""",
)
def added_extractor(spark: SparkSession, sf: str) -> DataFrame:
    extractors = (*BUILT_IN, MountExtractor())
    extracted = extract_ungated(d.derive(spark, sf, "server_files"), extractors)
    index = apply_gates(extracted, org_settings(spark, sf), extractors)
    return tables.routes(index).filter(F.col("framework") == "mounts").select("file", "path")
