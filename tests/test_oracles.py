"""Every registered query runs; those with SQL agree with DuckDB on columns, rows and values."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, norm

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def test_oracle_names_are_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_flagship(spark, data):
    df = entry.entry(spark)
    assert {"stratum", "group1", "group2", "p_value", "p_adj"} <= set(df.columns)
    df.collect()
