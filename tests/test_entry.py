"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from codelake import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    a = registry.QUERIES[name](spark, SF).toPandas()
    assert len(a)
    if name in registry.SQL:
        b = duck.execute(registry.SQL[name]).df()
        cols = sorted(a.columns)
        rows = lambda d: sorted((tuple(plain(v) for v in r) for r in d[cols].itertuples(index=False)), key=repr)
        assert cols == sorted(b.columns) and rows(a) == rows(b)
