"""The registered queries against their SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from spanlake.plans import registry


def canonical(v):
    if v is None or v != v:
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLE_SQL if n[0] in "aiw" or n in ("g12_service_edges", "s02_search_tfidf", "c04_call_edges", "g07_ancestor_closure", "c13_pattern_findings")))
def test_query_equals_sql(spark, duck, data, name):
    got = registry.QUERIES[name](spark, data)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(canonical, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(canonical, r)) for r in want.fetchall())
