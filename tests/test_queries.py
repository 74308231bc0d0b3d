"""Every registered query of the base library against its SQL."""

import os

import duckdb
import pytest

from scriptorium import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_against_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = df.select(sorted(df.columns)).collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(names) == sorted(df.columns)
