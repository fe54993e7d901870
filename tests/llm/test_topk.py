import math
import random

import numpy as np

from tessera.llm import topk


def brute(rows, k, every):
    vectors = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return out


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 0.4) for _ in range(8)]) for i in range(700)]
    rows[20] = (20, rows[0][1])  # ties
    rows += [(i, rows[3][1]) for i in range(700, 1300)]  # a very common vector
    rows += [(2000, None), (2001, [float("nan")] * 8), (2020, [None] + [0.1] * 7), (2040, [float("inf")] * 8), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame.createOrReplaceTempView("x")
    vectors = frame.filter(topk.usable("embedding") & frame.vec_id.isNotNull()).select("vec_id", topk.whole("embedding").alias("vector"))
    got = topk.top_k(vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vectors, 20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 20)
    none = vectors.limit(0)
    assert topk.top_k(none.withColumnRenamed("vec_id", "query_id"), vectors, 5).count() == 0
    assert topk.top_k(vectors.withColumnRenamed("vec_id", "query_id"), none, 5).count() == 0


def test_blocks_below_the_kth_are_passed_over():
    draw = np.random.default_rng(1)
    centres = draw.integers(-60, 60, (20, 16))
    vectors = np.concatenate([c + draw.integers(-3, 4, (topk.BLOCK, 16)) for c in centres])
    ids = np.arange(len(vectors))
    queries = vectors[::97]
    q, c, s, scored = topk.search(ids[::97], queries, np.full(len(queries), -(1 << 62)), ids, vectors, 10)
    assert scored < 0.6 * len(queries) * 20
    for i in (0, 5, len(queries) - 1):
        own = ids[::97][i]
        want = sorted((-int(queries[i] @ v), j) for j, v in enumerate(vectors) if j != own)[:10]
        assert [(-x, y) for x, y in zip(s[q == own].tolist(), c[q == own].tolist())] == want


def test_few_candidates_and_lengths():
    q, c, s, _ = topk.search(np.array([1]), np.array([[2, 3]]), np.array([-(1 << 62)]), np.array([1, 5, 4]), np.array([[2, 3], [1, 0], [1, 0]]), 20)
    assert list(zip(c.tolist(), s.tolist())) == [(4, 2), (5, 2)]


def test_ranges_of_similar_vectors_share_thresholds(spark, monkeypatch):
    """Vectors of forty directions in any order: the ranges gather them, and most pairs of a query and a block are passed over."""
    monkeypatch.setattr(topk, "CELL_BLOCKS", 4)
    draw = np.random.default_rng(6)
    centres = draw.integers(-60, 60, (40, 16))
    rows = [(i, (centres[i * 7 % 40] + draw.integers(-3, 4, 16)).tolist()) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    queries = frame.filter("vec_id % 300 = 0").withColumnRenamed("vec_id", "query_id")
    scored, all_pairs = topk.pairs_scored(queries, frame, 10)
    assert scored < 0.25 * all_pairs, (scored, all_pairs)
    got = sorted(map(tuple, topk.top_k(queries, frame, 10).collect()))
    want = []
    for q in range(0, 6000, 300):
        best = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:10]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_products_beyond_64_bits_saturate():
    big = np.array([[1 << 62, 1 << 62]])
    assert topk._product(big, big).tolist() == [[(1 << 63) - 1]] and topk._product(big, -big).tolist() == [[-(1 << 63)]]
    assert topk._product(np.array([[1 << 31]]), np.array([[1 << 30]])).tolist() == [[1 << 61]]
