"""The registered llm queries on the smallest driver tables: shape, plans, and SQL where there is any."""

import os

import pytest

from evalweave.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
#: The columns that the statements of the problems name.
FOUND = {
    "p2_found": ["generation_id"], "p3_found": ["generation_id", "defect"], "p4_found": ["record_kind", "key_lo", "key_hi"], "p5_found": ["idx_lo", "idx_hi"],
    "p6_found": ["generation_id", "field_name"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for table in os.listdir(FOLDER):
            con.sql(f"create view {table.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{table}')")
        want = con.sql(queries.SQL[name])
        assert want.columns == df.columns and sorted(want.fetchall(), key=str) == sorted(rows, key=str)


def test_types(spark):
    kinds = {n: dict(queries.QUERIES[n](spark, FOLDER).dtypes) for n in ("p4_found", "p5_found", "p10_found")}
    assert kinds["p4_found"] == {"record_kind": "string", "key_lo": "bigint", "key_hi": "bigint"}
    assert kinds["p5_found"] == {"idx_lo": "bigint", "idx_hi": "bigint"} and kinds["p10_found"] == {"doc_id": "bigint", "reading_level": "int"}
