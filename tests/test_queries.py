"""Every registered query of the plans against its SQL on the driver's smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera import plans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return connection


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) and math.isfinite(v) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, tables, name):
    got = plans.queries()[name](spark, SMALL)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    found = tables.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
