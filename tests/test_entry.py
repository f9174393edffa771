"""Every registered query runs on the smallest tables and agrees with its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v


def table(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


#: Queries without rows on the smallest tables, and why.
EMPTY = {"p10_found": "too few ratings to learn from"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    if name not in ORACLES:
        rows = got.collect()
        assert rows or name in EMPTY
        if name.endswith("_found"):
            assert len(rows) == len({tuple(r) for r in rows})
        return
    got, want = got.toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
