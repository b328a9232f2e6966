"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lakeledger.plans.views import TABLES

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
LLM = set(entry.LLM_QUERIES)      # tested where they live


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LLM))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got[1]
        return
    relation = duck.sql(ORACLE[name])
    assert got == canonical(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert not {name for name in QUERIES if name not in LLM} - set(ORACLE)
