"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lintel.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
