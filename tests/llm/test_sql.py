"""The queries that have SQL against it, on the tables of sf0.01."""

from __future__ import annotations

import duckdb
import pytest

from quillstone.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    frame = queries.QUERIES[name](spark, DIR)
    assert sorted(frame.columns) == sorted(want.columns)
    got = sorted(map(repr, (tuple(r) for r in frame.select(*want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall()))
