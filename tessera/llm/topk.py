"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors take the place of documents and their dimensions that of terms. All vectors are put in one order, in
which similar ones are next to each other (by nearest pivot, then by the product with it), and cut into ranges.
A block is a piece of a range with a forward index (the vectors themselves) and the largest and least value of
each term in it. For a query, the summed term maxima of a block bound every score in it: blocks are scored in
falling order of that bound, until the bound falls below the query's k-th score. A first search in the range
of the query's own pivot gives every range a threshold to begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import settle, table

#: Vectors of a block, blocks of a range, about, and queries that meet a range at once, about.
BLOCK, CELL_BLOCKS, CELL_QUERIES = 128, 32, 1024
#: Pivots, and the vectors that they are fitted to at most.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Products of whole numbers are exact in doubles below this.
EXACT = float(1 << 53)
RESULT = "query_id bigint, vec_id bigint, score bigint"


def whole(vector: str | Column, factor: int = 64) -> Column:
    """Each component x as floor(factor * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to one width."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten()).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _width(column: pa.Array) -> int:
    return int(max(column.value_lengths().fill_null(0).to_pylist(), default=0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles where these are exact; beyond 64 bits the nearest number of 64 bits."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of each query within one cell, a query's own id aside; ties to the smaller id. Scores below a query's floor are left out.

    Blocks are ranges of the vectors as given. Returns query ids, candidate ids, scores, and the number of
    (query, block) pairs that were scored.
    """
    starts = list(range(0, len(ids), BLOCK))
    high = np.stack([vectors[s : s + BLOCK].max(0) for s in starts])
    low = np.stack([vectors[s : s + BLOCK].min(0) for s in starts])
    bounds = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    best = np.full((n, k), np.iinfo(np.int64).min)
    active, scored = np.arange(n), 0
    for r in range(len(starts)):
        block = turn[active, r]
        go = bounds[active, block] >= np.maximum(best[active, k - 1], floors[active])  # as much as the k-th may still win by its id
        active, block = active[go], block[go]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(block).tolist():
            at = active[block == b]
            own = ids[starts[b] : starts[b] + BLOCK]
            scores = _product(queries[at], vectors[starts[b] : starts[b] + BLOCK])
            all_ids = np.concatenate([best_id[at], np.broadcast_to(own, scores.shape)], 1)
            all_scores = np.concatenate([best[at], scores], 1)
            skip = np.concatenate([np.zeros((len(at), k), bool), (own[None, :] == query_ids[at][:, None]) | (scores < floors[at][:, None])], 1)
            all_scores[skip], all_ids[skip] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            first = _first(all_scores, all_ids, k)
            best[at] = np.take_along_axis(all_scores, first, 1)
            best_id[at] = np.take_along_axis(all_ids, first, 1)
    row, rank = np.nonzero(best_id != np.iinfo(np.int64).max)
    return query_ids[row], best_id[row, rank], best[row, rank], scored


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties by the smaller id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    by_score = np.argsort(~np.take_along_axis(scores, by_id, 1), axis=1, kind="stable")  # ~x falls as x rises, without overflow
    return np.take_along_axis(by_id, by_score, 1)[:, :k]


def _pivots(sample: list[list[int]]) -> np.ndarray:
    """Up to PIVOTS centres of a sample, by a few rounds of k-means."""
    width = max(map(len, sample), default=0)
    if not width:
        return np.zeros((1, 1))
    vectors = np.zeros((len(sample), width))
    for row, vector in zip(vectors, sample):
        row[: len(vector)] = vector
    centres = np.unique(vectors[np.random.default_rng(3).permutation(len(vectors))[:PIVOTS]], axis=0)
    for _ in range(4):
        nearest = (vectors @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        count = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(count, np.stack([np.bincount(nearest, v, len(centres)) for v in vectors.T], 1) / np.maximum(count, 1), centres)
    order, left = [0], set(range(1, len(centres)))
    while left:  # each pivot's number is next to that of one near it
        rest = np.array(sorted(left))
        order.append(int(rest[((centres[rest] - centres[order[-1]]) ** 2).sum(1).argmin()]))
        left.remove(order[-1])
    return centres[order]


def _placed(frame: DataFrame, id_column: str, pivots: np.ndarray) -> DataFrame:
    """With pivot, the nearest one, and by, the product with it."""
    half = (pivots**2).sum(1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["vector"], max(_width(batch["vector"]), pivots.shape[1])).astype(np.float64)
            products = vectors[:, : pivots.shape[1]] @ pivots.T
            nearest = (products - half).argmax(1)
            yield pa.RecordBatch.from_arrays([batch[id_column], batch["vector"], pa.array(nearest.astype(np.int32)), pa.array(products[np.arange(len(nearest)), nearest])], [id_column, "vector", "pivot", "by"])

    return frame.select(F.col(id_column).cast("bigint").alias(id_column), "vector").mapInArrow(place, f"{id_column} bigint, vector array<bigint>, pivot int, by double")


def _met(queries: DataFrame, candidates: DataFrame, k: int, count: bool = False) -> DataFrame:
    """Each cell (d, a) of queries and candidates searched: query_id, vec_id, score; with count, query_id -1, vec_id the pairs of queries and blocks, and score those that were scored."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        a = b = s = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            right = right.sort_by([("pivot", "ascending"), ("by", "ascending"), ("vec_id", "ascending")])
            qv, cv = left["vector"].combine_chunks(), right["vector"].combine_chunks()
            width = max(_width(qv), _width(cv), 1)
            a, b, s, scored = search(left["query_id"].to_numpy(), _matrix(qv, width), left["floor"].to_numpy(), right["vec_id"].to_numpy(), _matrix(cv, width), k)
            if count:
                a, b, s = np.array([-1]), np.array([left.num_rows * -(-right.num_rows // BLOCK)]), np.array([scored])
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    queries = queries.select(F.col("d").alias("qd"), F.col("a").alias("qa"), "query_id", "vector", "floor")
    return queries.groupBy("qd", "qa").cogroup(candidates.groupBy("d", "a")).applyInArrow(cell, RESULT)


def _search(queries: DataFrame, candidates: DataFrame, k: int, count: bool = False) -> DataFrame:
    n, m = candidates.count(), queries.count()
    across = max(1, -(-n // (BLOCK * CELL_BLOCKS)))
    down = max(1, -(-m // CELL_QUERIES))
    pivots = _pivots([r.vector for r in candidates.orderBy(F.xxhash64("vec_id", "vector")).limit(PIVOT_SAMPLE).select("vector").collect()])
    lowest = F.lit(-(1 << 63)).cast("bigint")
    group = F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int")
    c = settle(_placed(candidates, "vec_id", pivots).repartitionByRange(across, "pivot", "by", "vec_id").withColumn("a", F.spark_partition_id()))
    q = settle(_placed(queries, "query_id", pivots).withColumns({"d": group, "floor": lowest}))
    if across > 1:
        homes = c.groupBy("pivot").agg(F.min("a").alias("a"))  # at most PIVOTS rows
        home = q.join(F.broadcast(homes), "pivot").select("query_id", "vector", "d", "a", "floor")
        near = c.join(home.select("d", "a").distinct(), "a")
        floors = _met(home, near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
        q = q.join(floors, "query_id", "left").withColumn("floor", F.coalesce("least", "floor"))
    q = q.select("query_id", "vector", "d", "floor", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"))
    c = c.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return _met(q, c, k, count)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k highest integer inner products of each query with all candidates.

    queries: query_id, vector array<bigint>; candidates: vec_id, vector; other columns are ignored. Returns query_id,
    rank (from 1), vec_id, score. A candidate with the query's own id is no candidate of it; shorter vectors count as
    padded with zeros; ties go to the smaller vec_id; repeated candidates count each; query_id is a key of queries, and null
    vectors are to be left out before, as usable() does. No queries or no candidates give no rows. Every (group of queries, range of candidates) meets in one cell, whose size
    does not grow with the input; equal vectors are told apart by their ids, so they spread over ranges.
    """
    rank = F.row_number().over(_window())
    return _search(queries, candidates, k).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_scored(queries: DataFrame, candidates: DataFrame, k: int) -> tuple[int, int]:
    """Pairs of a query and a block that top_k scores, and all there are."""
    row = _search(queries, candidates, k, count=True).agg(F.sum("score"), F.sum("vec_id")).first()
    return row[0] or 0, row[1] or 0


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", whole("embedding").alias("vector"))
    return top_k(vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), vectors, 20)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
