"""Every query with an SQL text gives the same rows as DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from claimscope import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    own = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in own.itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
