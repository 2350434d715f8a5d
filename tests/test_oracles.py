"""Every query of the library proper against its SQL in DuckDB."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

from quillstone.plans import registry

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    frame = registry.QUERIES[name](spark, DIR)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(found.columns)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    at = [found.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want
    assert got, "no rows to compare"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
