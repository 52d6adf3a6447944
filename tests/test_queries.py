"""The registered queries of the core against their SQL, on the smallest driver tables."""

import os

import pandas as pd
import pytest

from evalweave.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
#: Nested loops of these have one row on a side.
ONE_ROW = {"q23_contamination"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{name}')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return str(v) if isinstance(v, (str, bool)) or hasattr(v, "year") else repr(round(float(v), 5) + 0.0)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or name in ONE_ROW), plan
    got = df.toPandas()
    assert not df.columns or len(set(df.columns)) == len(df.columns)
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_sql_belongs_to_queries():
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
