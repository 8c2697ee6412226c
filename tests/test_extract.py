import random

from helpers import apply
from pyspark.sql import functions as F

from quillmap.functions.brackets import DEPTH, spans, split_top_level
from quillmap.functions.text import strip_comments
from quillmap.operators.extract import components as comp
from quillmap.operators.extract import modules as mod
from quillmap.operators.extract import routes as rt
from quillmap.operators.extract import schemas as sch


def test_exports(spark):
    cases = {
        "export function a() {}\nexport const b = 1;\nexport class C {}": [
            ("a", "function"), ("b", "const"), ("C", "class"),
        ],
        "export default function Page() {}": [("Page", "default")],
        "export default () => 1": [("default", "default")],
        "export default async function F() {}": [("async", "default")],
        "export default function() {}": [("function", "default")],
        "export const enum X {}": [("enum", "const")],
        "export { a, b as c, d as default, };": [("a", "const"), ("c", "const")],
        "export type { T };": [],
        "export let x = 1; export { x };": [("x", "const")],
        "class Foo {}\nmodule.exports = Foo;": [("Foo", "default")],
        "module.exports = { a, b: 1, 'c': 2, ...d };": [("a", "const"), ("b", "const")],
        "exports.hi = 1; module.exports.bye = 2;": [("hi", "const"), ("bye", "const")],
        "module.exports = function M() {}": [("M", "function")],
        "module.exports = require('x')": [("require", "default")],
        "module.exports = {}; module.exports = Late;": [],
        "export function* gen() {}": [("gen", "function")],
        "export const a\N{NO-BREAK SPACE}= 1; export\N{NO-BREAK SPACE}const b = 1": [
            ("a", "const"), ("b", "const"),
        ],
    }
    assert apply(spark, list(cases), mod.exported_symbols) == list(cases.values())


def test_imports(spark):
    def build(c):
        return mod.normalize_imports(mod.import_specifiers(c))

    many = "".join(f'import "m{i}";import "fs";' for i in range(20))
    cases = {
        'import fs from "node:fs"; import S from "stripe"; const x = require("./l");': ["stripe", "./l"],
        "import 'a'; export * from 'b'; import 'a'; export { c } from 'c'": ["a", "b", "c"],
        'import x from "fs/promises"': ["fs/promises"],
        'import  from "q"': ["q"],
        many: [f"m{i}" for i in range(15)],
        "nothing": [],
    }
    assert apply(spark, list(cases), build) == list(cases.values())


def test_call_routes(spark):
    cases = {
        'app.get("/h", f); router.post(`/o`, f); app.use("/api", router)': [
            ("express", "GET", "/h"), ("express", "POST", "/api/o"),
        ],
        "myRouter.all('/x'); app.use('/a', r); app.use('/b', r)": [("express", "ALL", "/x")],
        'axios.get("/x")': [("express", "GET", "/x")],
        "a.get('/x\")": [],
        "éapp.get('/x')": [("express", "GET", "/x")],
        'router.get("/x"); app.use("/a/", router)': [("express", "GET", "/a/x")],
    }
    assert apply(spark, list(cases), rt.call_routes) == list(cases.values())


def test_file_routes(spark):
    body = F.lit("export async function POST() {}\nexport function GET() {}\nexport const GETX = 1")
    cases = {
        "app/api/pay/route.ts": [("GET", "/api/pay"), ("POST", "/api/pay")],
        "app/users/[id]/page.tsx": [("GET", "/users/:id")],
        "src/app/(shop)/[...all]/page.jsx": [("GET", "/*all")],
        "app/page.tsx": [("GET", "/")],
        "app/page.ts": [("GET", "/page.ts")],
        "app/route.ts": [("GET", "/route.ts"), ("POST", "/route.ts")],
        "app/[[...opt]]/page.tsx": [("GET", "/:[...opt]")],
        "pages/api/users.ts": [("ALL", "/api/users")],
        "pages/index.tsx": [("GET", "/")],
        "pages/a/index.tsx": [("GET", "/a")],
        "pages/_app.tsx": [],
        "pages/foo/route.ts": [("GET", "/pages/foo"), ("POST", "/pages/foo")],
        "app/layout.tsx": [],
    }
    got = apply(spark, list(cases), lambda c: rt.file_routes(c, body))
    assert [[r[1:] for r in rows] for rows in got] == list(cases.values())


def test_components(spark):
    cases = {
        '"use client";\nexport function A({ x, y: z, ...r }: P) { useState(1); return <b/> }': [
            ("A", ["x", "y", "r"], True, ["useState"]),
        ],
        "const A = ({ x }) => <b/>": [("A", [], False, None)],
        "const A = async ({ x }) => <b/>": [("A", ["x"], False, None)],
        "function a() { return <b/> }": [],
        "function A() { return 1 }": [],
        "function A() { return (1) } const A = () => 2; const B = () => 3": [
            ("A", [], False, None), ("B", [], False, None),
        ],
        "function A(props) { return (useB(useA(1))) }": [("A", [], False, ["useA", "useB"])],
    }
    got = apply(spark, list(cases), lambda c: comp.components(c, strip_comments(c)))
    assert got == list(cases.values())


def test_models_and_tables(spark):
    models = {
        "model O {\n id String @id\n // c\n total Float\n @@x([id])\n alone\n}": [
            ("prisma", "O", ["id", "total"]),
        ],
        "model A { a Int }\nmodel B {\n}": [("prisma", "A", ["a"]), ("prisma", "B", [])],
    }
    assert apply(spark, list(models), sch.models) == list(models.values())
    deep = "(" * (DEPTH + 5) + "1" + ")" * (DEPTH + 5)
    ddl = {
        "CREATE TABLE users (id uuid PRIMARY KEY, email text, PRIMARY KEY (id));": [
            ("postgres", "users", ["id", "email"]),
        ],
        "create table if not exists s.t(a numeric(10, 2) check (f(a, (1))), \"b\" int)": [
            ("postgres", "t", ["a", "b"]),
        ],
        "-- create table c (x int);": [("postgres", "c", ["x"])],
        "create table t (\n a int,\n -- note\n b int\n)": [("postgres", "t", ["a"])],
        'create table "s"."t" (a int)': [],
        "create table a (x int, create table b (y int)": [
            ("postgres", "a", []), ("postgres", "b", ["y"]),
        ],
        f"create table d (a int default {deep}, b int); create table e (c int)": [
            ("postgres", "d", ["a", "b"]), ("postgres", "e", ["c"]),
        ],
        "create table x. (a int)": [("postgres", "x.", ["a"])],
        "select 1": [],
    }
    assert apply(spark, list(ddl), sch.ddl_tables) == list(ddl.values())


def test_collections_and_types(spark):
    cases = {
        'const S = new mongoose.Schema({ a: { b: 1, c: 2 }, "d": [1, 2], e });\nmongoose.model("Seat", S)': [
            ("mongo", "Seat", ["a", "d"]),
        ],
        "const S = new Schema<T>({ a: 1 }); const Q = new Schema({ b: 1 })": [
            ("mongo", "S", ["a"]), ("mongo", "S", ["b"]),
        ],
        "export default new Schema({ a: 1 })": [("mongo", "Collection", ["a"])],
        "new Schema({ a: 1": [("mongo", "Collection", [])],
        "new Schema({ a: ')', b: 1, c: '(', d: 2 })": [("mongo", "Collection", ["a", "d"])],
    }
    assert apply(spark, list(cases), sch.collections) == list(cases.values())
    types = {
        "Tables: { users: { Row: { id: string\n n: number | null } Insert: {} } }": [
            ("postgres", "users", ["id", "n"]),
        ],
        "users: { Row: { id: string } }": [],
    }
    assert apply(spark, list(types), sch.typed_tables) == list(types.values())


def _span(text: str, at: int) -> str:
    depth = 1
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return text[at:i]
    return ""


def _parts(text: str) -> list[str]:
    depth, parts, cur = 0, [], ""
    for c in text:
        depth += (c in "({[") - (c in ")}]")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [*parts, cur]


def test_brackets_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab(),,[]{}#") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["#(" * 30 + "x" + ")" * 30, "#(" + "(" * 20 + ")" * 19]
    got = apply(spark, texts, lambda c: spans(c, r"#\(", 0, "(", ")"))
    want = [[_span(s, i + 2) for i in range(len(s)) if s[i : i + 2] == "#("] for s in texts]
    assert got == want
    lead = lambda c: F.transform(
        split_top_level(c, r"({\[", r")}\]"), lambda p: F.regexp_extract(p, "^[ab#]*", 0)
    )
    heads = [["".join(_head(p)) for p in _parts(s)] for s in texts]
    assert apply(spark, texts, lead) == heads


def _head(part: str):
    for c in part:
        if c not in "ab#":
            return
        yield c
