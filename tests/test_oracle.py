"""Every registered query of the engine runs; those with SQL give what DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from gridloom import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    assert rows
    if name in queries.ORACLE:
        result = duck.execute(queries.ORACLE[name])
        columns = [d[0] for d in result.description]
        order = [columns.index(c) for c in sorted(columns)]
        want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
        assert sorted(columns) == sorted(found.columns)
        assert rows == want
