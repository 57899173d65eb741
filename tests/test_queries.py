"""Registered queries against their SQL."""

import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return float(v) if not isinstance(v, str) else v


def check(spark, run, sql, data=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = run(spark, str(data))
    rows, want = found.collect(), con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def _names():
    from amountlake.plans.registry import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from amountlake.plans.registry import ORACLE_SQL, QUERIES

    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
