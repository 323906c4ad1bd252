"""Every registered query with SQL against DuckDB on the smallest tables; the rest must run."""


import duckdb
import pytest

from vantage import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    shape = lambda found, names: sorted(str(tuple(r[names.index(c)] for c in order)) for r in found)
    assert shape(rows, df.columns) == shape(cur.fetchall(), columns)


def test_entry_names_are_unique():
    assert len(registry.queries()) >= 90 and set(registry.oracle_sql()) <= set(registry.queries())
