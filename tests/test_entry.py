"""Every registered query against its oracle SQL on the smallest tables, where those are present."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog

DATA = os.environ.get("LEDGERLOOM_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "ledger_balance_check" in entry.queries()


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE:
        return
    r = duck.sql(catalog.ORACLE[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
