import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "benchmark", "conversations", "labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def names():
    import tokenloom.plans.queries as own

    return sorted(own.QUERIES)


def cells(rows, order):
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert cells(rows, [df.columns.index(c) for c in sorted(columns)]) == cells(want.fetchall(), [columns.index(c) for c in sorted(columns)])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "token"] and df.count() == 4096


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
