"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from rowloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    return (1, float(f"{float(v):.8g}") + 0.0) if isinstance(v, int | float) else (2, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in queries.ORACLE:
        assert got
        return
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
