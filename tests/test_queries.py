"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from cohortkit.plans import registry
from cohortkit.sources.tables import parquet_tables
from oracle_queries import all_sql

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")

QUERIES, SQL = registry.all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def test_names_agree():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 80
    assert set(SQL) <= set(entry_module.oracle_sql()) and set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if any(
            isinstance(x, float) for x in a) and None not in a and None not in b and not any(
            isinstance(x, str) for x in a) else a == b


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "target" in df.columns


PARTITION_FREE = ["exposure_days", "lab_sequence", "apply_exclusions", "rank_sum", "balance_table",
                  "propensity_match"]


@pytest.mark.parametrize("name", PARTITION_FREE)
def test_same_result_at_other_partitioning(spark, name):
    run = lambda: sorted(map(repr, QUERIES[name](spark, FOLDER).collect()))
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["center_month"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "o_orderpriority" not in orders.split("ReadSchema")[1]


def test_reader(spark):
    assert parquet_tables(spark, FOLDER + "/")("region").count() == 5
