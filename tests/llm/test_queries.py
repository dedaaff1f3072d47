"""The numbered queries that have SQL against it, on the smallest tables."""

from pathlib import Path

import pytest

from cohortkit.llm.queries import QUERIES
from cohortkit.llm.sql import SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(([r[c] for c in order] for r in df.collect()), key=repr)
    want = sorted(([r[columns.index(c)] for c in order] for r in result.fetchall()), key=repr)
    assert got == want
