"""Queries of training-data operators against their SQL."""

import duckdb
import pytest

from tessella.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)
