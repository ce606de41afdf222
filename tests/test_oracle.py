"""Every registered query against its DuckDB statement (the driver's gate),
on the smallest driver data: row count, column names, order-insensitive hash."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from orderdesk import catalog, oracle
from tools.check_oracle import TABLES, digest

from .conftest import SMOKE_DIR

QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMOKE_DIR}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "month_name", "revenue", "orders", "avg_order_value"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
