"""Every registered query runs; those with an oracle equal DuckDB's rows."""

import decimal
import math
import os

import duckdb
import pytest

from tessella import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v) if not isinstance(v, str) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns
    if name in plans.ORACLES:
        found = duck.execute(plans.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        ours = sorted(tuple(plain(r[c]) for c in order) for r in rows)
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
        assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
