"""Queries that SQL can express give what DuckDB gives on the same files."""

import duckdb
import pytest

from waveloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF).select(columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
