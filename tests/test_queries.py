"""Every registered query with SQL must equal DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from periodica.catalog.registry import REGISTRY, TABLES
from tools.compare import plain

FOLDER = "/root/testdata/sf0.001"
OWN = set(REGISTRY)
QUERIES = {k: v for k, v in entry_module.queries().items() if k in OWN}
SQL = {k: v for k, v in entry_module.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=key)
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert cols == [names[i] for i in order]
    assert got == sorted([tuple(plain(r[i]) for i in order) for r in cur.fetchall()], key=key)


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
