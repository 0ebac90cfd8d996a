"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from recordloom.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else repr(round(float(v), 9))
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in oracle_sql():  # no SQL can express it: tested in test_units.py
        assert got
        return
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
