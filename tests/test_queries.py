"""Every registered query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewater import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(type(v)), 0 if v is None else v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got
    if sql := registry.oracle_sql().get(name):
        res = duck.execute(sql)
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == table(columns, res.fetchall())
