"""Registered queries of this subpackage against their SQL in DuckDB."""

import duckdb
import pytest

from tidewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(want, key=str) == sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    q = duck.sql(queries.oracle_sql()[name])
    kinds = {"long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t.replace("bigint", "long")] for c, t in df.dtypes} == dict(zip(q.columns, map(str, q.types), strict=True))
