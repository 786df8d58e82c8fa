"""Every query with SQL gives what that SQL gives in DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from plumbline.oracle import SQL
from plumbline.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
