"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidewright.plans import ORACLES, QUERIES
from tidewright.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if math.isnan(float(x)) else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return str(x)[:10] if x.time() == datetime.time() else str(x)
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in ORACLES:
        q = duck.sql(ORACLES[name])
        at = [q.columns.index(c) for c in cols]
        assert len(cols) == len(q.columns)
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=str)
