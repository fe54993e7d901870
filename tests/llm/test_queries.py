"""The registered queries on the driver's smallest tables, against their SQL where they have any."""

import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def available():
    return os.path.isdir(SMALL)


@pytest.mark.skipif(not available(), reason="the driver's tables are not here")
def test_queries_against_sql(spark):
    from tessera.llm import registry

    connection = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    sql = registry.oracle_sql()
    for name in sql:
        got = registry.queries()[name](spark, SMALL)
        found = connection.execute(sql[name])
        columns = [c[0] for c in found.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, found.fetchall())), name


@pytest.mark.skipif(not available(), reason="the driver's tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= n
        n = left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == n
