"""Every query against its DuckDB statement on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from mailsleuth.plans.catalog import all_queries
from mailsleuth.plans.fixtures import BASE_TABLES
from oracle import oracle_sql

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLE, QUERIES = oracle_sql(), all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    return round(x, 6) if isinstance(x, float) else x


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    if name not in ORACLE:
        return
    cur = duck.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(got, df.columns) == _rows(cur.fetchall(), cols)


def test_only_named_queries_lack_a_statement():
    assert set(QUERIES) - set(ORACLE) <= {"f02_content_text", "f14_punycode_text"}
