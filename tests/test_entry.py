"""Each query with SQL gives the SQL's rows on small tables."""

import glob
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def normal(x):
    return "None" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def database():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    found = __spark_entry__.queries()[name](spark, DATA)
    cursor = database.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    rows = lambda it: sorted(tuple(map(normal, r)) for r in it)
    assert rows(found.select(*names).collect()) == rows(cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
