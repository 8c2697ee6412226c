"""Scalar text functions, all built from native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx


def _class_of(chars: str) -> str:
    """Inside of a character class, neighbours written as ranges."""
    points = sorted(map(ord, chars))
    out = ""
    while points:
        end = next(i for i, p in enumerate([*points, -1]) if p != points[0] + i) - 1
        out += f"\\x{{{points[0]:x}}}" + (f"-\\x{{{points[end]:x}}}" if end else "")
        points = points[end + 1 :]
    return out


_SPACE_CLASS = _class_of(fx.JS_WHITESPACE)
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def js(pattern: str) -> str:
    r"""Java pattern with ECMAScript meaning of ``\s``, ``\S`` and ``\b``."""
    return (
        pattern.replace(r"\s", f"[{_SPACE_CLASS}]")
        .replace(r"\S", f"[^{_SPACE_CLASS}]")
        .replace(r"\b", _WORD_EDGE)
    )


# The second branch takes an unclosed comment to the end of the text and puts
# it back, so a text full of openers is still scanned once.
_BLOCK_COMMENT = r"/\*[\S\s]*?\*/|(/\*[\S\s]*)\z"
_LINE_COMMENT = r"(^|[^:])//[^\n]*"
_LINE_BREAK = r"\n\r\x{2028}\x{2029}"
_BLANK_IN_LINE = _class_of("".join(c for c in fx.JS_WHITESPACE if c not in "\n\r\u2028\u2029"))
_CLIENT_DIRECTIVE = rf"(?:\A|[{_LINE_BREAK}])[{_BLANK_IN_LINE}]*[\"']use client[\"']"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(fx.JS_WHITESPACE))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(fx.JS_WHITESPACE))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def utf16_left(c: Column, n: int) -> Column:
    """First ``n`` UTF-16 units; a pair cut in half becomes U+FFFD."""
    head = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    last = F.hex(F.substring(head, 2 * n - 1, 1))
    cut_pair = F.concat(F.decode(F.substring(head, 1, 2 * n - 2), "UTF-16BE"), F.lit("\ufffd"))
    return (
        F.when(utf16_length(c) == F.length(c), F.left(c, F.lit(n)))
        .when(last.between("D8", "DB"), cut_pair)
        .otherwise(F.decode(head, "UTF-16BE"))
    )


def tokens_of_length(n: Column) -> Column:
    return F.ceil(n / fx.CHARS_PER_TOKEN).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    return tokens_of_length(utf16_length(c))


def icu(c: Column) -> Column:
    """The same text, ordered by the root locale instead of by bytes."""
    return F.collate(c, "UNICODE")


def extension(path: Column) -> Column:
    return F.when(F.instr(path, ".") == 0, F.lit("")).otherwise(
        F.lower(F.substring_index(path, ".", -1))
    )


def language(ext: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fx.LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(names, ext), ext)


def short_hash(content: Column) -> Column:
    return F.left(F.sha1(content), F.lit(8))


def line_count(content: Column) -> Column:
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content == "", 0).otherwise(breaks + 1).cast("bigint")


def strip_comments(content: Column) -> Column:
    no_blocks = F.when(
        F.contains(content, F.lit("/*")), F.regexp_replace(content, _BLOCK_COMMENT, "$1")
    ).otherwise(content)
    return F.regexp_replace(no_blocks, _LINE_COMMENT, "$1")


def directory(path: Column) -> Column:
    above = F.length(path) - F.length(base_name(path)) - 1
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.left(path, above))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_client(raw: Column) -> Column:
    return F.rlike(raw, F.lit(_CLIENT_DIRECTIVE))


def decision_title(text: Column) -> Column:
    short = F.concat(rtrim(utf16_left(text, fx.TITLE_CUT)), F.lit("…"))
    return F.when(utf16_length(text) > fx.TITLE_LIMIT, short).otherwise(text)


def or_placeholder(c: Column, placeholder: str = "…") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(placeholder))


def clean_answer(text: Column) -> Column:
    opened = F.regexp_replace(text, js(fx.ANSWER_FENCE_START), "")
    return trim(F.regexp_replace(opened, js(fx.ANSWER_FENCE_END), ""))
