"""Routes: by file name for web pages, by call for servers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.arrays import find_all, find_matches, let, matches
from quillmap.operators.extract.base import FileColumns, empty_list, has_extension


def _route(framework: str, method: Column, url: Column) -> Column:
    return F.struct(
        F.lit(framework).alias("framework"), method.alias("method"), url.alias("url")
    )


def _dynamic(segment: Column) -> Column:
    rest = F.regexp_replace(segment, r"^\[\.\.\.(.+)\]\z", r"*$1")
    return F.regexp_replace(rest, r"^\[(.+)\]\z", ":$1")


def below_src(path: Column) -> Column:
    return F.regexp_replace(path, "^src/", "")


def app_url(rel: Column) -> Column:
    bare = F.regexp_replace(
        F.regexp_replace(rel, "^app/", ""), r"/(page|route)\.(tsx?|jsx?)\z", ""
    )
    bare = F.when(bare.isin("page.tsx", "page.jsx") | (bare == rel), "").otherwise(bare)
    visible = F.filter(F.split(bare, "/"), lambda s: ~F.rlike(s, F.lit(r"^\(.*\)\z")))
    return F.concat(F.lit("/"), F.array_join(F.transform(visible, _dynamic), "/"))


def pages_url(rel: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(rel, "^pages/", ""), r"\.(tsx?|jsx?)\z", "")
    # The last segment "index" goes, and then a whole path "index".
    bare = F.regexp_replace(F.regexp_replace(bare, r"/index\z", ""), r"^index\z", "")
    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(bare, "/"), _dynamic), "/"))


def exported_verbs(clean: Column) -> Column:
    found = find_all(clean, fx.EXPORTED_VERB)
    return F.array_intersect(F.array(*[F.lit(v) for v in fx.HTTP_VERBS]), found)


def file_routes(path: Column, clean: Column) -> Column:
    rel = below_src(path)
    framework = "nextjs"
    return (
        F.when(
            matches(rel, fx.ROUTE_FILE),
            F.transform(exported_verbs(clean), lambda v: _route(framework, v, app_url(rel))),
        )
        .when(matches(rel, fx.PAGE_FILE), F.array(_route(framework, F.lit("GET"), app_url(rel))))
        .when(
            F.startswith(rel, F.lit("pages/api/")),
            F.array(_route(framework, F.lit("ALL"), pages_url(rel))),
        )
        .when(
            F.startswith(rel, F.lit("pages/")) & ~F.startswith(rel, F.lit("pages/_")),
            F.array(_route(framework, F.lit("GET"), pages_url(rel))),
        )
        .otherwise(empty_list("routes"))
    )


def call_routes(clean: Column) -> Column:
    routes = let(find_all(clean, fx.MOUNT_CALL, 2), lambda mounts: _mounted_routes(clean, mounts))
    # Starting at a dot is much cheaper than trying every word of the text.
    return F.when(matches(clean, fx.CALL_VERB), routes).otherwise(empty_list("routes"))


def _mounted_routes(clean: Column, mounts: Column) -> Column:
    def build(receiver: Column, verb: Column, url: Column) -> Column:
        mounted = F.regexp_replace(F.concat(F.get(mounts, F.lit(0)), url), "/{2,}", "/")
        takes_mount = (F.size(mounts) == 1) & F.contains(F.lower(receiver), F.lit("router"))
        return _route("express", F.upper(verb), F.when(takes_mount, mounted).otherwise(url))

    return find_matches(clean, fx.CALL_ROUTE, build, 1, 2, 4)


class FileRouteExtractor:
    name = "nextjs"
    stacks = ("nextjs",)

    def applies(self, file: FileColumns) -> Column:
        return matches(file.path, fx.WEB_ROOTS)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"routes": F.array_distinct(file_routes(file.path, file.clean))}


class CallRouteExtractor:
    name = "express"
    stacks = ("express",)

    def applies(self, file: FileColumns) -> Column:
        return has_extension(file, fx.SCRIPT_EXTENSIONS)

    def lists(self, file: FileColumns) -> dict[str, Column]:
        return {"routes": F.array_distinct(call_routes(file.clean))}
