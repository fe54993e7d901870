"""The inverted-file index against all products: uploads that can be repeated, partitions read, recall, and the exact search."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as vx

SCHEMA = "id long, document_id string, vector array<double>"


def points(n=1500, width=12, seed=0):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(20, width))
    return (heads[draw.integers(0, 20, n)] + 0.35 * draw.normal(size=(n, width))).tolist()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    held = points()
    rows = [(i, f"d{i % 40}", v) for i, v in enumerate(held)]
    rows += [(9000, "bad", None), (9001, "bad", [float("nan")] * 12), (9002, "zero", [0.0] * 12)] + [(9100 + i, "same", held[0]) for i in range(30)]
    path = f"file://{tmp_path_factory.mktemp('ivf')}"
    vx.create(spark.createDataFrame(rows, SCHEMA), path, 24)
    return path, {i: v for i, _, v in rows if i not in (9000, 9001)}


def brute(held, questions, limit):
    ids = np.array(sorted(held))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
    matrix = unit(np.array([held[i] for i in ids.tolist()]))
    out = set()
    for q, v in questions:
        if v is not None:
            scores = np.round(unit(np.array(v)) @ matrix.T, 9)
            order = [j for j in np.lexsort((ids, -scores)).tolist() if ids[j] != q][:limit]
            out |= {(q, int(ids[j]), rank + 1) for rank, j in enumerate(order)}
    return out


def test_search(spark, index, monkeypatch):
    path, held = index
    questions = [(i, held[i]) for i in range(0, 1500, 50)] + [(77777, None), (9002, held[9002])]
    asked = spark.createDataFrame(questions, "query_id long, vector array<double>")
    want = brute(held, questions, 10)
    exact = vx.search(asked, path, 10, probes=2, exact=True)
    assert {(r.query_id, r.id, r["rank"]) for r in exact.collect()} == want
    near = {(r.query_id, r.id) for r in vx.search(asked, path, 10, probes=4).filter("query_id < 9000").collect()}
    wanted = {(q, i) for q, i, _ in want if q < 9000}
    assert len(near & wanted) >= 0.9 * len(wanted)
    monkeypatch.setattr(vx, "CELL", 16)
    monkeypatch.setattr(vx, "QUESTIONS", 3)
    assert {(r.query_id, r.id, r["rank"]) for r in vx.search(asked, path, 10, probes=2, exact=True).collect()} == want


def test_few_partitions_are_read(spark, index):
    path, held = index
    asked = spark.createDataFrame([(0, held[0])], "query_id long, vector array<double>")
    assert vx.search(asked, path, 5, probes=3).count() == 5
    scanned = vx.stored(spark, path).filter("list in (1, 2, 3)")
    assert "PartitionFilters: [list" in scanned._jdf.queryExecution().executedPlan().toString()
    files = {r[0] for r in scanned.select(F.input_file_name()).collect()}
    assert {f.split("list=")[1][:2] for f in files} <= {"1/", "2/", "3/"}
    assert len(glob.glob(f"{path[7:]}/lists/list=*")) > 12


def test_upload_again(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    held = points(300)
    vx.create(spark.createDataFrame([(i, f"d{i % 5}", v) for i, v in enumerate(held)], SCHEMA), path, 8)
    new = spark.createDataFrame([(1000 + i, "d1", held[0]) for i in range(3)] + [(1, "d2", None)], SCHEMA)
    for _ in range(2):
        vx.upload(new, path)
        got = {(r.id, r.document_id) for r in vx.stored(spark, path).collect()}
        assert got == {(i, f"d{i % 5}") for i in range(300) if i % 5 not in (1, 2)} | {(1000 + i, "d1") for i in range(3)}
    rows = spark.read.parquet(f"{path}/centres").collect()
    assert sum(r.n for r in rows) == 183
    asked = spark.createDataFrame([(5, held[5])], "query_id long, vector array<double>")
    left = {r.id: list(r.vector) for r in vx.stored(spark, path).collect()}
    assert {(r.query_id, r.id, r["rank"]) for r in vx.search(asked, path, 6, 1, exact=True).collect()} == brute(left, [(5, held[5])], 6)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/y"
    vx.create(spark.createDataFrame([], SCHEMA), path)
    asked = spark.createDataFrame([(5, [1.0])], "query_id long, vector array<double>")
    assert vx.search(asked, path, 6, exact=True).count() == 0
