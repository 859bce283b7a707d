from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from feedmart import queries as feed

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["tokenize_titles", "search_topk", "collapse_series", "dedupe_titles", "set_operations", "run_shapes", "recovered_rows", "health_messages", "tool_search_requests", "tribe_scan"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = feed.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(feed.SQL[name])
    assert sorted(want.columns) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda got: sorted(repr([plain(v) for v in r]) for r in got)
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({feed.SQL[name]})").fetchall())
