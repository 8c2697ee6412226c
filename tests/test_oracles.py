"""Every checked query against its SQL on the smallest sample tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillmap.checks import ORACLES, QUERIES
from quillmap.checks.derived import TABLES

SF_DIR = os.environ.get("QUILLMAP_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, datetime.datetime):
        value = value.replace(tzinfo=None)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(ORACLES[name])
    at = [result.columns.index(c) for c in sorted(result.columns)]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sorted(result.columns) == columns
    assert got == want and got
