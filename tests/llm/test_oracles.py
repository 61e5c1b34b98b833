"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from lodeweave.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)
