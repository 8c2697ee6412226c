"""Trees of files: the directory frontier, links, and the data source with its filters."""

import os

import pytest
from pyspark.sql import functions as F

from quillmap.checks import QUERIES, file_checks
from quillmap.sources.files import list_repo_files, read_repo_files
from quillmap.sources.repo_source import register


def grow(top, width, depth):
    names = []
    for i in range(width):
        (top / f"f{i}.ts").write_text(f"{top.name}{i}")
        names.append(f"f{i}.ts")
        if depth:
            (top / f"d{i}").mkdir()
            names += [f"d{i}/{n}" for n in grow(top / f"d{i}", width, depth - 1)]
    return names


def test_one_large_tree_is_listed_by_many_tasks(spark, tmp_path):
    (tmp_path / "big").mkdir()
    (tmp_path / "small").mkdir()
    names = grow(tmp_path / "big", 4, 4)
    (tmp_path / "small" / "a.ts").write_text("")
    repos = spark.createDataFrame([("big", f"{tmp_path}/big"), ("small", f"{tmp_path}/small")], "repo string, root string").coalesce(1)
    listed = list_repo_files(repos, share=20)
    assert sorted((r.repo, r.path) for r in listed.collect()) == sorted([("big", n) for n in names] + [("small", "a.ts")])
    # Every part file is what one task listed.
    parts = listed.where("repo = 'big'").groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < len(names) / 2


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "r" / "a").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.ts").write_text("x")
    (tmp_path / "r" / "a" / "b.ts").write_text("b")
    os.symlink(tmp_path / "r", tmp_path / "r" / "a" / "parent")
    os.symlink(tmp_path / "out", tmp_path / "r" / "sibling")
    os.symlink(tmp_path / "out" / "x.ts", tmp_path / "r" / "link.ts")
    repos = spark.createDataFrame([("r", f"{tmp_path}/r")], "repo string, root string")
    assert [(r.path, r.content) for r in read_repo_files(repos).collect()] == [("a/b.ts", "b")]


def test_no_repositories(spark):
    assert list_repo_files(spark.createDataFrame([], "repo string, root string")).collect() == []


def test_filtered_files_are_not_opened(spark, tmp_path):
    """The time of last access tells which files were opened."""
    paths = ["r/src/a.ts", "r/src/deep/b.ts", "r/src/c.md", "r/lib/a.ts", "q/src/a.ts", "r/node_modules/m.ts"]
    for path in paths:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    register(spark)
    reader = spark.read.format("repo_files").option("splits", "3").option("repo.r", f"{tmp_path}/r").option("repo.q", f"file://{tmp_path}/q")

    def opened(df):
        for path in paths:
            os.utime(tmp_path / path, (1, 2))
        rows = sorted((r.repo, r.path) for r in df.select("repo", "path").collect())
        return rows, {p for p in paths if os.stat(tmp_path / p).st_atime != 1}

    every = sorted((r.repo, r.path, r.content) for r in reader.load().collect())
    assert every == sorted((*p.split("/", 1), p) for p in paths if "node_modules" not in p)
    if opened(reader.load())[1] != set(paths) - {"r/node_modules/m.ts"}:
        pytest.skip("this file system keeps no access times")
    files = reader.load().where("path like 'src/%' and path like '%.ts' and repo = 'r' and length(content) > 0")
    assert opened(files) == ([("r", "src/a.ts"), ("r", "src/deep/b.ts")], {"r/src/a.ts", "r/src/deep/b.ts"})
    assert opened(reader.load().where(F.col("repo").isin("none"))) == ([], set())
    assert opened(reader.load().where("path = 'lib/a.ts'")) == ([("r", "lib/a.ts")], {"r/lib/a.ts"})
    assert opened(reader.load().where("not path like '%.ts'")) == ([("r", "src/c.md")], {"r/src/c.md"})


def test_a_wide_frontier_is_listed_in_one_more_pass(spark, tmp_path):
    """Directories that were handed over are all listed by the next pass, by several tasks."""
    for i in range(300):
        (tmp_path / "wide" / f"d{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"d{i}" / "a.ts").write_text(str(i))
    repos = spark.createDataFrame([("wide", f"{tmp_path}/wide")], "repo string, root string")
    listed = list_repo_files(repos, share=2)
    folders = {r[0].rsplit("/", 1)[0] for r in listed.select(F.input_file_name()).distinct().collect()}
    tasks = listed.groupBy(F.input_file_name()).count().collect()
    assert listed.count() == 300 and len(folders) == 2 and len(tasks) > 3
    contents = read_repo_files(repos)
    assert sorted(int(r.content) for r in contents.collect()) == list(range(300))
    assert contents.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_checked_trees_hold_a_file_for_each_key(spark, tmp_path):
    """Repeated keys share a file, as in Spark's own layout, and tasks of several parts write."""
    rows = [(i, f"s{i}", i % 3, 1.0) for i in range(40)] + [(7, "s7", 1, 1.0), (50, None, 2, 1.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = sorted([(f"org{i % 3}", i, f"s{i}\n" * (2 if i == 7 else 1)) for i in range(40)] + [("org2", 50, "\n")])
    assert sorted(map(tuple, QUERIES["read_repo_files"](spark, str(tmp_path)).collect())) == want
    kept = sorted(map(tuple, QUERIES["read_repo_source"](spark, str(tmp_path)).collect()))
    assert kept == [r for r in want if str(r[1]).startswith("1")]
    tree = file_checks._tree(spark, str(tmp_path))
    assert sorted(os.listdir(tree)) == ["org=org0", "org=org1", "org=org2"] and os.listdir(f"{tree}/org=org1/s_suppkey=7") == ["part-00000.txt"]
