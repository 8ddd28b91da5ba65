"""Each query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from roadlens.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name in registry.oracle_sql():
        rel = oracle.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
