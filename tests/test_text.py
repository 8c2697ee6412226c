from helpers import apply
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions import text as t


def test_whitespace_set():
    assert len(fx.JS_WHITESPACE) == 25 and len(set(fx.JS_WHITESPACE)) == 25
    assert all(c.isspace() or c == "\N{ZERO WIDTH NO-BREAK SPACE}" for c in fx.JS_WHITESPACE)


def test_trim_takes_all_blanks(spark):
    assert apply(spark, [" \N{NO-BREAK SPACE}a b\N{IDEOGRAPHIC SPACE}\n", "\N{NEXT LINE}x", ""], t.trim) == [
        "a b", "\N{NEXT LINE}x", "",
    ]


def test_strip_comments(spark):
    cases = {
        "a /* x\n y */ b": "a  b",
        "a // x\nb": "a \nb",
        'u = "http://h"; // t': 'u = "http://h"; ',
        "/* never closed // x": "/* never closed ",
        "/*/ a */ b": " b",
        "// first": "",
        "/*a*/x/*b": "x/*b",
        "": "",
    }
    assert apply(spark, list(cases), t.strip_comments) == list(cases.values())


def test_strip_comments_stays_linear(spark):
    text = "/* " * 200_000
    assert apply(spark, [text], t.strip_comments) == [text]


def test_lengths_count_utf16_units(spark):
    face = "\N{GRINNING FACE}"
    assert apply(spark, ["", "abcd", "abcde", face * 2, face * 2 + "a"], t.estimate_tokens) == [0, 1, 2, 1, 2]
    assert apply(spark, ["abcdef", face + "bc", "a" + face, "ab"], lambda c: t.utf16_left(c, 2)) == [
        "ab", face, "a\N{REPLACEMENT CHARACTER}", "ab",
    ]


def test_path_parts(spark):
    paths = ["a/b.ts", "x.MJS", "Makefile", "a.b/c", "d/.env"]
    assert apply(spark, paths, t.extension) == ["ts", "mjs", "", "b/c", "env"]
    assert apply(spark, paths, t.directory) == ["a", ".", ".", "a.b", "d"]
    assert apply(spark, paths, t.base_name) == ["b.ts", "x.MJS", "Makefile", "c", ".env"]
    assert apply(spark, ["mjs", "tsx", "py", ""], t.language) == ["js", "tsx", "py", ""]
    assert apply(spark, ["a\\b\\c"], t.forward_slashes) == ["a/b/c"]


def test_counts_and_hashes(spark):
    assert apply(spark, ["", "a", "a\n", "\n\n"], t.line_count) == [0, 1, 2, 3]
    assert apply(spark, ["hello"], t.short_hash) == ["aaf4c61d"]


def test_client_directive(spark):
    cases = {
        '"use client";': True, "  'use client'": True, "a\n\n  'use client'": True,
        "x 'use client'": False, '"use  client"': False, "a\r\t\"use client\"": True,
    }
    assert apply(spark, list(cases), t.is_client) == list(cases.values())


def test_titles_and_answers(spark):
    long = "x" * 55 + "   " + "y" * 10
    assert apply(spark, ["a" * 60, "a" * 61, long], t.decision_title) == [
        "a" * 60, "a" * 57 + "…", "x" * 55 + "…",
    ]
    answers = ['```json\n{"a": 1}\n```', '```JSON {"a": 1}```  ', ' {"a": 1} ', "x ``` y"]
    assert apply(spark, answers, t.clean_answer) == ['{"a": 1}'] * 3 + ["x ``` y"]


def test_directory_is_cut_without_a_pattern(spark):
    paths = ["a/b/c", "/x", "a/", "é/🙂/文.ts", "a\nb/c\nd", "//", "", None]
    assert apply(spark, paths, t.directory) == ["a/b", "", "a", "é/🙂", "a\nb", "/", ".", None]
    assert "regexp" not in str(t.directory(F.col("value"))).lower()
