"""Every query with SQL against DuckDB on the smallest tables; the rest for rows and a stable schema."""

import glob
import os

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in registry.ORACLE:
        cur = db.execute(registry.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert plain(rows) == plain(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_sql_only_for_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
