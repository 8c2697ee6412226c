"""Globs of ignore files as regular expressions."""

import re

from quillmap.functions.globs import any_regex, glob_regex, literal_directory
from quillmap.operators import ignore
from pyspark.sql import functions as F

CASES = [
    ("**/*.py[cod]", ["a.pyc", "d/a.pyd", "a.pyo"], ["a.py", "a.pyx", "a.py/"]),
    ("**/[Bb]in", ["bin", "a/Bin/x.ts", "Bin"], ["sbin", "binx", "BIN"]),
    ("src/{a,b}/**", ["src/a/x", "src/b/y/z"], ["src/c/x", "x/src/a/x", "src/ab/x"]),
    ("x{a,b{c,d}}y", ["xay", "xbcy", "xbdy"], ["xby", "xacy", "xa,by"]),
    ("{a", ["{a"], ["a"]), ("a}", ["a}"], ["a"]), ("{a}", ["{a}"], ["a"]), ("a,b", ["a,b"], ["a"]), ("{a,b", ["{a,b"], ["a"]),
    ("{1..3}.ts", ["1.ts", "3.ts"], ["4.ts", "{1..3}.ts"]), ("{c..a}", ["b"], ["d"]),
    ("[!a-c]x", ["dx", "-x"], ["ax", "cx", "/x"]), ("[^a]", ["b"], ["a", "/"]), ("a[/]b", [], ["a/b"]),
    ("[]a]", ["]", "a"], ["b"]), ("[a-]", ["a", "-"], ["b"]), ("[z-a]", [], ["z", "m", "a"]), ("[a", ["[a"], ["a"]),
    (r"[\]x]", ["]", "x"], ["\\"]), ("[a&&b]", ["a", "&", "b"], ["c"]), (r"\*a", ["*a"], ["xa"]), (r"a\{b,c\}", ["a{b,c}"], ["ab"]),
    ("a.b+c$", ["a.b+c$"], ["axb+c$"]), ("a?c", ["abc"], ["a/c", "ac"]), ("*", ["a", "a/b"], []), ("**/logs", ["logs", "a/logs/x.ts"], ["logs.ts"]),
    ("{**/,}x", ["x", "a/x"], ["xx"]), ("{a,}b", ["ab", "b"], ["cb"]), ("[0-9]{x,[ab]}", ["1x", "2a"], ["1c"]),
]


def test_translation(spark):
    globs = [g for g, _, _ in CASES]
    df = spark.createDataFrame(list(enumerate(globs)), "i int, g string")
    rows = df.select("i", any_regex(F.array(glob_regex(F.col("g")))).alias("r"), literal_directory(F.col("g")).alias("d")).collect()
    pattern = {r.i: re.compile(r.r.replace(r"\z", r"\Z")) for r in rows}
    for i, (glob, hits, misses) in enumerate(CASES):
        assert [p for p in hits if not pattern[i].search(p)] == [] == [p for p in misses if pattern[i].search(p)], glob
    assert {globs[r.i]: r.d for r in rows if r.d} == {"src/{a,b}/**": "src"}
    both = df.crossJoin(spark.createDataFrame([(p,) for _, h, m in CASES for p in h + m], "p string").distinct())
    found = both.select("i", "p", F.rlike("p", any_regex(F.array(glob_regex(F.col("g"))))).alias("hit")).collect()
    assert all(r.hit == bool(pattern[r.i].search(r.p)) for r in found)


def test_rules_of_a_directory_meet_its_paths_only(spark):
    lines = "/src/gen/*.ts\nsrc/{x,y}/tmp\n/docs/api/v[12]/\n*.bak\n/a/b/c\n@(q|r).ts\n"
    files = spark.createDataFrame([("r", ".gitignore", lines)], "repo string, path string, content string")
    configs = spark.createDataFrame([("r", ["lib/**/z.ts"])], "repo string, ignore array<string>")
    globs = ignore.ignore_globs(files, configs)
    rules = ignore.ignore_rules(globs)
    assert set(rules.first().ignored.below) == {"src/gen", "docs/api", "a/b", "lib"}
    paths = {"src/gen/a.ts": 0, "src/gen/d/a.ts": 1, "src/x/tmp/q": 0, "k/src/y/tmp": 0, "docs/api/v1/i.ts": 0, "docs/api/v3/i.ts": 1,
             "z/o.bak": 0, "a/b/c": 0, "a/b/c/d": 0, "a/b/cc": 1, "lib/z.ts": 0, "lib/m/n/z.ts": 0, "z.ts": 1, "q.ts": 1}
    rows = spark.createDataFrame([("r", p) for p in paths] + [("none", "a/b/c")], "repo string, path string")
    kept = {(r.repo, r.path) for r in ignore.drop_ignored(rows, rules).collect()}
    assert kept == {("r", p) for p, keep in paths.items() if keep} | {("none", "a/b/c")}
    assert [tuple(r) for r in ignore.rejected_globs(globs).collect()] == [("r", "**/@(q|r).ts")]
