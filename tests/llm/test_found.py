"""The queries on the smallest tables: SQL where there is one, columns and ids otherwise."""

import glob
import os

import pytest

from tolmach.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["tbl", "id_a", "id_b"], "p2_found": ["id_a", "id_b"], "p3_found": ["tbl", "id"], "p4_found": ["id", "defect"], "p5_found": ["tbl", "id_a", "id_b"],
    "p6_found": ["file_id", "unit_key", "form_index", "field", "id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS.get(name, df.columns)
    if name != "p7_ids":
        assert len(rows) == len(set(rows))
    if name in SQL:
        import duckdb

        db = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        assert sorted(rows) == sorted(db.execute(SQL[name]).fetchall())


def test_no_cross_joins(spark, data):
    for name, query in QUERIES.items():
        text = query(spark, data)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text, name
