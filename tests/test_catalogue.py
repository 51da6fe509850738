import math
import os

import pytest

import __spark_entry__ as entry
from factloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.Q[name](spark, SF)
    want = db.execute(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
