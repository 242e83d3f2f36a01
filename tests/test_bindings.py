"""Every query that has SQL gives what DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from changelens.plans import bindings

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None or pd.isna(x):
        return None
    try:
        return round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def rows(df, names):
    return sorted((str([cell(x) for x in r]) for r in df[names].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, con, name):
    got = bindings.QUERIES[name](spark, DATA).toPandas()
    if name not in bindings.ORACLES:
        assert len(got.columns)
        return
    want = con.execute(bindings.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
