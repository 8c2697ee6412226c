import json
import random

import sample
from pyspark.sql import functions as F

from quillmap.operators import budget, ignore, snapshot, tables, validate
from quillmap.operators.stack import repo_stacks
from quillmap.plans import bundle, export
from quillmap.plans.index import build_index, current_hashes, write_snapshot
from quillmap.plans.joins import first_per_key, join_by_repo, number_rows
from quillmap.plans.storage import fresh_folder
from quillmap.sources.documents import document_body, front_matter
from quillmap.sources.json_elements import is_json
from quillmap.sources.files import list_repo_files, read_listed_files, read_repo_files, source_files

FILE = "repo string, path string, content string"
DOC = "repo string, doc string, body string"
TASK = (
    "repo string, id string, title string, suited array<string>, status string, "
    "claimed_by string, notes string, deps array<string>"
)


def project(spark, config="{}", previous=None):
    files = spark.createDataFrame(sample.rows(), FILE)
    configs = spark.createDataFrame([("shop", config)], "repo string, text string")
    return files, configs, *build_index(files, configs, previous)


def test_sample_project(spark):
    _, _, index, settings = project(spark)
    assert {r.path for r in index.collect()} == {
        "app/api/pay/route.ts", "app/board/[id]/page.tsx", "src/components/Card.tsx",
        "src/models/Seat.ts", "src/server.ts", "db/001.sql", "prisma/schema.prisma", "lib/db.ts",
    }
    assert settings.first().stack == ["express", "mongoose", "nextjs", "prisma", "react"]
    assert {(r.method, r.path) for r in tables.routes(index).collect()} == {
        ("GET", "/api/pay"), ("POST", "/api/pay"), ("GET", "/board/:id"), ("GET", "/health"),
        ("POST", "/api/orders"),
    }
    assert {r.name: r.props for r in tables.components(index).collect()} == {
        "BoardPage": [], "Card": ["cartId", "rest"],
    }
    assert {(r.engine, r.name): r.columns for r in tables.db_tables(index).collect()} == {
        ("postgres", "users"): ["id", "price"], ("postgres", "orders"): ["id"],
        ("prisma", "Order"): ["id", "total"], ("mongo", "Seat"): ["token", "userId", "expires"],
    }


def test_config_gates(spark):
    config = '{"extractors": {"express": false, "react": null}, "ignore": ["lib/**"]}'
    _, _, index, _ = project(spark, config)
    assert "lib/db.ts" not in {r.path for r in index.collect()}
    assert "express" not in {r.framework for r in tables.routes(index).collect()}
    assert tables.components(index).count() == 2


def test_unchanged_snapshot_changes_nothing(spark):
    files, configs, index, settings = project(spark)
    noted = index.withColumn("purpose", F.when(F.col("lang") == "ts", "note")).withColumn(
        "purpose_stale", F.col("path") == "src/server.ts"
    )
    again, _ = build_index(files, configs, noted)
    columns = [c for c in noted.columns if c != "state"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, noted.select(columns).collect()))
    assert snapshot.run_counters(again).collect() == [("shop", 0, 8)]
    now = current_hashes(files, settings)
    assert snapshot.drift(now, again, again).collect() == [("shop", 0)]
    path = fresh_folder(spark, "snapshots")
    for _ in range(2):
        write_snapshot(again, path, "one")
    write_snapshot(again, path, "two")
    assert spark.read.parquet(path).groupBy("snapshot").count().count() == 2
    assert spark.read.parquet(path).count() == 16


def test_changed_purposes(spark):
    previous = spark.createDataFrame(
        [("r", "same", "h", "p", True), ("r", "edit", "old", "p", False), ("r", "bare", "old", None, True),
         ("r", "gone", "h", "p", False)],
        "repo string, path string, hash string, purpose string, purpose_stale boolean",
    )
    current = spark.createDataFrame(
        [("r", "same", "h"), ("r", "edit", "new"), ("r", "bare", "new"), ("r", "add", "h")],
        "repo string, path string, hash string",
    )
    got = {r.path: (r.purpose, r.purpose_stale, r.state) for r in snapshot.carry_over(current, previous).collect()}
    assert got == {
        "same": ("p", True, "reused"), "edit": ("p", True, "changed"), "bare": (None, False, "changed"),
        "add": (None, False, "new"),
    }
    assert snapshot.drift(current, previous, previous).collect() == [("r", 4)]
    assert snapshot.drift(current, previous.filter("false"), previous.filter("false")).collect() == [("r", -1)]


def test_stack_detection(spark):
    rows = [
        ("a", "package.json", '{"name": "x", "dependencies": {"next": "1"}, "devDependencies": {"prisma": "1"}}'),
        ("b", "prisma/schema.prisma", ""), ("b", "supabase/x.sql", ""), ("b", "next.config.ts", ""),
        ("c", "package.json", '{"name": 5, "dependencies": ["express"]}'),
        ("d", "package.json", "{'name': 'x'}"), ("e", "sub/package.json", '{"dependencies": {"next": "1"}}'),
    ]
    got = {r.repo: (r.project_name, r.stack) for r in repo_stacks(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {
        "a": ("x", ["nextjs", "prisma"]), "b": ("project", ["nextjs", "prisma", "supabase"]),
        "c": ("5", []), "d": ("project", []), "e": ("project", []),
    }


def test_source_paths(spark):
    paths = ["a.ts", "a.TS", "x/dist/a.ts", "dist.ts", "a.min.js", "a.d.ts", "b/.c/d.ts", "q.sql", "a.map", "m.map/x.js", "outer/a.js", "out/a.js"]
    rows = spark.createDataFrame([("r", p, "") for p in paths], FILE)
    assert {r.path for r in source_files(rows).collect()} == {"a.ts", "dist.ts", "q.sql", "outer/a.js"}


def test_ignore_rules(spark):
    files = spark.createDataFrame([("r", ".gitignore", "﻿/top\n name/ \n*.log.ts\n**/deep\na.b\n\n/\n")], FILE)
    configs = spark.createDataFrame([("r", ["gen/**"])], "repo string, ignore array<string>")
    rules = ignore.ignore_rules(ignore.ignore_globs(files, configs))
    paths = {"top/a.ts": 0, "x/top/a.ts": 1, "x/name/y.ts": 0, "x/name": 0, "q.log.ts": 0, "z/q.log.ts": 0,
             "u/deep/v.ts": 0, "axb": 1, "a.b": 0, "gen/a.ts": 0, "x/gen/a.ts": 1}
    rows = spark.createDataFrame([("r", p) for p in paths] + [("other", "top/a.ts")], "repo string, path string")
    kept = {(r.repo, r.path) for r in ignore.drop_ignored(rows, rules).collect()}
    assert kept == {("r", p) for p, keep in paths.items() if keep} | {("other", "top/a.ts")}


def greedy(sections, limit):
    used, forms = 0, {}
    for priority, name, body, short in sorted(sections):
        full, brief = -(-len(body) // 4), -(-len(short or "") // 4)
        if not body:
            forms[name] = "empty"
        elif used + full <= limit:
            used, forms[name] = used + full, "full"
        elif brief and used + brief <= limit:
            used, forms[name] = used + brief, "collapsed"
        else:
            forms[name] = "dropped"
    return forms


def test_budget_against_brute_force(spark):
    rng = random.Random(3)
    groups = {}
    for g in range(40):
        n = 400 if g == 0 else rng.randint(0, 12)
        groups[f"g{g}"] = [
            (rng.randint(1, 9), f"s{i:03d}", "x" * rng.choice([0, 1, 5, 9, 40, 90, 500]),
             rng.choice([None, "", "y" * rng.randint(1, 30)]))
            for i in range(n)
        ]
    rows = [(g, *s) for g, sections in groups.items() for s in sections]
    df = spark.createDataFrame(rows, "repo string, priority int, name string, body string, collapsed string")
    got = {}
    for r in budget.section_forms(df, 40).collect():
        got.setdefault(r.repo, {})[r.name] = r.form
    assert got == {g: greedy(s, 40) for g, s in groups.items() if s}
    kept = {r.repo: (len(r.kept), len(r.collapsed)) for r in budget.assemble(df, 40).collect()}
    for g, forms in got.items():
        counts = list(forms.values())
        assert kept[g] == (counts.count("full"), counts.count("collapsed"))


def test_budget_collapses(spark):
    big = "\n".join(f"file-{i}.ts details" for i in range(500))
    rows = [("r", 1, "state", "  STATE kept \n", None), ("r", 10, "files", big, "### Files\n- src/ — 500 files")]
    df = spark.createDataFrame(rows, "repo string, priority int, name string, body string, collapsed string")
    r = budget.assemble(df, 100).first()
    assert r.text == "STATE kept\n\n### Files\n- src/ — 500 files" and r.tokens <= 100
    assert (r.kept, r.collapsed) == (["state"], ["files"])


def test_bundles(spark):
    _, _, index, settings = project(spark)
    documents = spark.createDataFrame(
        [("shop", "state", "\nfine\n"), ("shop", "plan", " \n"), ("other", "handoff", "left"),
         ("shop", "decisions", "# D\n\n## 2024-01-01 — a\n\nb\n")], DOC,
    )
    tasks = spark.createDataFrame([("shop", "t-001", "T", [], "claimed", "me", "", [])], TASK)
    got = {r.repo: r for r in bundle.bundles(index, settings, documents, tasks).collect()}
    text = got["shop"].text
    assert "## Current State\nfine\n\n## Tasks\n### Open tasks\n- t-001 T [] (claimed by me)\n\n## Recent Decisions" in text
    assert "- POST /api/orders  →  src/server.ts" in text and "  db.ts — db, connect" in text
    assert got["shop"].tokens == -(-len(text[len("# Project Context\n\n"):-1]) // 4) + 5
    assert got["other"].text == "# Project Context\n\n## Last Handoff\nleft\n"
    tight = {r.repo: r.text for r in bundle.bundles(index, settings, documents, tasks, budget=75).collect()}
    assert "- 2 components" in tight["shop"] and "### Files" not in tight["shop"]
    none = {r.repo: r.text for r in bundle.bundles(index, settings, documents, tasks, budget=0).collect()}
    assert none["shop"] == "# Project Context\n\n_No state written yet._\n"


def test_blank_end_of_a_section_is_not_charged(spark):
    rows = [("r", "a.sql", [("postgres", "t", [])])]
    schema = "repo string, path string, tables array<struct<engine:string,name:string,columns:array<string>>>"
    lines = bundle.listing.db_lines(tables.db_tables(spark.createDataFrame(rows, schema)))
    costs = bundle.listing.section_costs(lines).first()
    text = bundle.listing.section_texts(lines).first().text
    assert text == "### Data model\n- t:" and costs.tokens == -(-len(text) // 4)


def test_costs_order_only_sections_with_a_blank_end(spark, monkeypatch):
    """Sums need no order; the end of the last line by locale counts, whatever lines end in blanks before it."""
    ordered = []
    rank = bundle.listing.line_order
    monkeypatch.setattr(bundle.listing, "line_order", lambda: ordered.append(1) or rank())
    plain = [("r", "files", "full", "d", k, "", "", 0, f"  {k}") for k in ("a", "B", "c")]
    schema = "repo string, section string, form string, group string, k1 string, k2 string, k3 string, pos int, line string"

    def costs(rows):
        got = bundle.listing.section_costs(spark.createDataFrame(rows, schema)).collect()
        return {(r.repo, r.section): (r.lines, r.tokens) for r in got}

    assert costs(plain) == {("r", "files"): (3, 6)} and not ordered
    assert costs([]) == {} and not ordered
    db = [("r", "db", "full", "1", k, "", "", 0, line) for k, line in [("a", "- a: x"), ("B", "- B:" + " " * 9)]]
    last = [(None, "db", "full", "1", k, "", "", 0, line) for k, line in [("a", "- a:" + " " * 9), ("B", "- B:" + " " * 9)]]
    null = [("n", "db", "full", "1", "a", "", "", 0, "- a: x"), ("n", "db", "full", "2", "a", "", "", 0, None)]
    mixed = [("m", "db", "full", "1", "a", "", "", 0, None), ("m", "db", "full", "2", "a", "", "", 0, "- a: x")]
    assert costs(plain + db + last + null + mixed) == {
        ("r", "files"): (3, 6), ("r", "db"): (2, 7), ("n", "db"): (2, None), ("m", "db"): (2, 6),
        (None, "db"): (2, 9),
    } and ordered


def test_lines_of_wanted_sections(spark):
    """Lines are made again only of repositories that kept the section; without any, no file is read for them."""
    _, _, index, _ = project(spark)
    every = {(r.section, r.form, r.line) for r in bundle.index_lines(index).collect()}
    wanted = spark.createDataFrame([("shop", "routes", "full"), ("shop", "db", "full"), ("other", "files", "full")], "repo string, section string, form string")
    got = {(r.section, r.form, r.line) for r in bundle.index_lines(index, wanted).collect()}
    assert got == {x for x in every if x[0] in ("routes", "db")} and len(got) < len(every)


def test_json_documents(spark):
    _, _, index, settings = project(spark)
    rows = export.snapshot_json_rows(index, settings, "2024-01-01T00:00:00.000Z")
    ordered = rows.orderBy("repo", *export.row_order()).collect()
    text = "\n".join(r.text for r in ordered)
    doc = json.loads(text)
    assert text == json.dumps(doc, indent=2, ensure_ascii=False)
    assert [f["path"] for f in doc["files"]][:2] == ["app/api/pay/route.ts", "app/board/[id]/page.tsx"]
    assert doc["stats"] == {"files": 8, "indexedFiles": 8, "loc": 52}
    path = fresh_folder(spark, "json")
    export.write_rows(rows, path)
    parts = spark.read.text(path + "/repo=shop").select("value", "_metadata.file_name").collect()
    assert len(parts) == len(text.split("\n"))
    documents = spark.createDataFrame([("shop", text), ("bad", text[:-3])], "repo string, value string")
    read = validate.snapshot_files(validate.read_snapshots(documents))
    assert read.count() == 8
    assert {(r.repo, r.problem) for r in validate.snapshot_problems(documents).collect()} == {
        ("bad", validate.MALFORMED)
    }
    texts = spark.createDataFrame([("shop", "s\n", None, "p", "")], "repo string, state string, handoff string, plan string, decisions string")
    tasks = spark.createDataFrame([("shop", "t-001", 'T "q"', ["a"], "open", None, "", [])], TASK)
    rows = export.bundle_json_rows(index, settings, texts, tasks)
    doc = json.loads("\n".join(r.text for r in rows.orderBy("repo", *export.row_order()).collect()))
    assert doc["tasks"][0]["title"] == 'T "q"' and doc["handoff"] == "" and len(doc["routes"]) == 5


def test_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 37) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "repo string, seq bigint, v bigint")
    numbered = {(r.repo, r.seq): r.n for r in number_rows(df, ["repo"], "seq", "n", buckets=8).collect()}
    want = {}
    for repo in {r[0] for r in rows}:
        for n, seq in enumerate(sorted(r[1] for r in rows if r[0] == repo), 1):
            want[repo, seq] = n
    assert numbered == want
    top = first_per_key(df, ["repo"], [F.col("v").desc(), F.col("seq")], 4, spread="seq").collect()
    for repo in {r[0] for r in rows}:
        best = sorted((-r[2], r[1]) for r in rows if r[0] == repo)[:4]
        assert sorted((-r.v, r.seq) for r in top if r.repo == repo) == best
    dims = spark.createDataFrame([("hot", 1), ("k0", 2)], "repo string, d int")
    joined = join_by_repo(df, dims, spread="seq")
    assert joined.count() == 1000 and joined.filter("d = 1").count() == sum(r[0] == "hot" for r in rows)


def test_reading_a_tree(spark, tmp_path):
    tree = {
        "r1/src/a.ts": b"x\xff\n", "r1/b.md": b"", "r1/.gitignore": b"b", "r1/pages/_app.tsx": b"",
        "r2/d/e/c.sql": b"select 1", "r2/locked.ts": b"x",
        "r1/app/[id]/route.ts": b"1", "r1/a b/c#d%20?.ts": b"2", "r2/(x)/[...all]/é.ts": b"3",
    }
    pruned = ["r1/node_modules/m/a.ts", "r2/d/.git/HEAD", "r2/dist/a.ts"]
    for path, data in {**tree, **dict.fromkeys(pruned, b"")}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    roots = [("r1", f"{tmp_path}/r1"), ("r2", f"file://{tmp_path}/r2/")]
    repos = spark.createDataFrame(roots, "repo string, root string")
    listed = list_repo_files(repos)
    assert list_repo_files(repos, pruned=[]).count() == len(tree) + len(pruned)
    gone = F.when(F.col("path") == "locked.ts", F.concat("file", F.lit("?"))).otherwise(F.col("file"))
    files = read_listed_files(listed.withColumn("file", gone), 2)
    got = {(r.repo, r.path): r.content for r in files.collect()}
    want = {tuple(k.split("/", 1)): v.decode(errors="replace") for k, v in tree.items()}
    assert got == {**want, ("r2", "locked.ts"): None}
    assert snapshot.count_errors(listed, files.filter("content is not null")).collect() == [("r2", 1)]
    assert read_repo_files(repos).count() == len(tree)


def test_documents(spark):
    from helpers import apply

    texts = ["---\na: 1\nb: x: y\na: 2\n---\nbody\n", "no front\n---\n", "---\n---\nz", "---\na: b ---\nc: d\n---\nz"]
    assert apply(spark, texts, front_matter) == [{"a": "2", "b": "x: y"}, {}, {}, {"a": "b ---", "c": "d"}]
    assert apply(spark, texts, document_body) == ["body\n", "no front\n---\n", "z", "z"]
    docs = ["{}", "[1]", "{} x", "{},{}", "", "{'a':1}", '"s"', "null"]
    docs += ['{"a":1}] trailing', '{"a":1}],[{"b":2}', "1] x", "[1]]", "1}", "[[]]"]
    ok = apply(spark, docs, is_json)
    assert ok == [True, True, False, False, False, False, True, True, False, False, False, False, False, True]
