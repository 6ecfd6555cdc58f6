"""Every query with SQL gives the same rows as DuckDB on the smallest test tables."""

import glob
import os

import duckdb
import pytest

from lexmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_as_sql(spark, sql, name):
    df = catalogue.queries()[name](spark, FOLDER)
    result = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
