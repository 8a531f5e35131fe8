"""Every query of the catalogue against its SQL on the smallest tables, and the plans that matter."""

import glob
import os
import re

import pytest

from tolmach.plans.catalogue import QUERIES, SQL


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def oracle(folder):
    import duckdb

    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = table_of(df.collect(), df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        found = oracle(data).execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == table_of(found.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    from tolmach.operators.reports import segments_page

    text = plan(segments_page(spark.read.parquet(f"{data}/segments.parquet"), status="approved", file_id=1).select("id"))
    assert "PushedFilters: [IsNotNull(file_id), IsNotNull(status), EqualTo(file_id,1), EqualTo(status,approved)]" in text
    assert "target_text" not in text.split("ReadSchema")[1]


def test_issue_filter_is_a_semi_join(spark, data):
    assert "LeftSemi" in plan(QUERIES["q_segments_with_issues"](spark, data))


def test_top_k_is_limited_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(QUERIES["q_semantic_matches"](spark, data))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_row_by_row_python_and_no_cross_join(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_the_core_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/tolmach/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", open(path, encoding="utf-8").read(), re.MULTILINE), path


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
