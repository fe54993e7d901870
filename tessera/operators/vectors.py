"""Inverted-file index of vectors: a table in lists of similar ones, uploaded by document and searched in few lists.

`<path>/lists` holds the vectors, partitioned by list, and `<path>/centres` each list's centre, size and radius (the widest
angle between the centre and one of its vectors). A search reads the partitions of the nearest lists alone. For an exact one the k-th
score of that search is what other lists have to reach: the angle to a list's centre less its radius bounds the score of all in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.postings import top
from tessera.shared import written

#: Lists at most, vectors that centres are fitted to for each list, vectors of a cell and questions that meet it at once.
LISTS, SAMPLE, CELL, QUESTIONS = 4096, 64, 4096, 2048
#: Angles are compared with this much to spare.
SLACK = 1e-6
ROWS = "list int, id bigint, document_id string, vector array<double>, angle double"


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column at length one; a zero vector stays one."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64).reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 1))
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor has null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", bad))


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by a few rounds of k-means on unit vectors."""
    centres = np.unique(sample[np.random.default_rng(5).permutation(len(sample))[:lists]], axis=0)
    for _ in range(6):
        nearest = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.stack([np.bincount(nearest, column, len(centres)) for column in sample.T], 1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def create(rows: DataFrame, path: str, lists: int | None = None) -> None:
    """A new index of rows (id, document_id, vector); lists: the square root of their number, if not given, and LISTS at most.

    Centres are fitted to SAMPLE vectors a list, chosen by a hash; all vectors are indexed. They are brought to the driver, which holds
    LISTS * SAMPLE of them at most.
    """
    rows = usable(rows)
    n = rows.count()
    lists = min(LISTS, max(1, round(n**0.5) if lists is None else lists))
    sample = [r.vector for r in rows.orderBy(F.xxhash64("id", "vector")).limit(lists * SAMPLE).select("vector").collect()]
    matrix = np.array(sample, np.float64).reshape(len(sample), -1) if sample else np.zeros((1, 1))
    centres = _fit(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300), lists)
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, c, 0, 0.0) for i, c in enumerate(centres.tolist())], "list int, centre array<double>, n bigint, radius double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([], ROWS).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    upload(rows, path)


def _centres(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # LISTS rows at most


def stored(spark: SparkSession, path: str) -> DataFrame:
    """list, id, document_id, vector, angle (to the list's centre) of all vectors."""
    return spark.read.schema(ROWS).parquet(f"{path}/lists").filter("id is not null")


def upload(rows: DataFrame, path: str) -> None:
    """Deletes the documents of rows (id, document_id, vector) from the index and inserts the rows: again, it changes nothing.

    Only the lists that held one of the documents, or now do, are written, each as a whole. A row of nulls stands in each, so that a list
    which has become empty is overwritten too. Vectors that usable() leaves out are not inserted, but their documents are deleted.
    """
    spark = rows.sparkSession
    known = _centres(spark, path)
    centres = np.array([r.centre for r in known])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit(batch["vector"])
            products = vectors @ centres.T if batch.num_rows else np.zeros((0, 1))
            nearest = products.argmax(1)
            angle = np.arccos(np.clip(products[np.arange(len(nearest)), nearest], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), batch["id"], batch["document_id"], batch["vector"], pa.array(angle)], ["list", "id", "document_id", "vector", "angle"])

    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("document_id").cast("string").alias("document_id"), F.col("vector").cast("array<double>").alias("vector"))
    new = written(usable(rows).mapInArrow(assign, ROWS))
    documents = rows.select("document_id").distinct()
    here = stored(spark, path)
    held = here.join(documents, "document_id", "left_semi").select("list").distinct()
    touched = [r.list for r in held.union(new.select("list")).distinct().collect()]
    if not touched:
        return
    stays = here.filter(F.col("list").isin(touched)).join(documents, "document_id", "left_anti").select(*new.columns)
    marks = spark.createDataFrame([(i, None, None, None, None) for i in touched], ROWS)
    now = written(stays.union(new).union(marks))
    spread = F.pmod(F.xxhash64("id"), F.lit(16))  # a large list is several files
    now.repartition("list", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/lists")
    seen = {r.list: r for r in now.filter("id is not null").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    rewritten = set(touched)
    table = [(r.list, r.centre, seen[r.list].n if r.list in seen else 0 if r.list in rewritten else r.n, seen[r.list].radius if r.list in seen else 0.0 if r.list in rewritten else r.radius) for r in known]
    spark.createDataFrame(table, "list int, centre array<double>, n bigint, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _scored(routed: DataFrame, path: str, known: list, limit: int, own: bool) -> DataFrame:
    """The best of each cell for each question (query_id, vector, list) that is sent to its list."""
    spark = routed.sparkSession
    load = {r.list: r["count"] for r in routed.groupBy("list").count().collect()}  # LISTS at most
    if not load:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double")
    cells = F.create_map(*[F.lit(x) for r in known if r.list in load for x in (r.list, max(1, -(-r.n // CELL)))])
    groups = F.create_map(*[F.lit(x) for i, n in load.items() for x in (i, max(1, -(-n // QUESTIONS)))])
    every = lambda counts: F.explode(F.sequence(F.lit(0), counts[F.col("list")] - 1))
    part = lambda column, counts: F.pmod(F.xxhash64(column), counts[F.col("list")]).cast("int")
    left = routed.select("list", every(cells).alias("cell"), part("query_id", groups).alias("turn"), "query_id", "vector")
    right = stored(spark, path).filter(F.col("list").isin(list(load))).select("list", part("id", cells).alias("cell"), every(groups).alias("turn"), "id", "vector")

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        q = i = np.zeros(0, np.int64)
        s = np.zeros(0)
        if asked.num_rows and held.num_rows:
            ids, names = held["id"].to_numpy(), asked["query_id"].to_numpy()
            scores = np.round(_unit(asked["vector"].combine_chunks()) @ _unit(held["vector"].combine_chunks()).T, 9)
            if not own:
                scores[names[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :limit]
            s = np.take_along_axis(scores, order, 1).ravel()
            q, i = np.repeat(names, order.shape[1])[np.isfinite(s)], ids[order.ravel()][np.isfinite(s)]
            s = s[np.isfinite(s)]
        return pa.table({"query_id": q, "id": i, "score": s})

    return left.groupBy("list", "cell", "turn").cogroup(right.groupBy("list", "cell", "turn")).applyInArrow(best, "query_id bigint, id bigint, score double")


def search(questions: DataFrame, path: str, limit: int, probes: int = 8, exact: bool = False, own: bool = False) -> DataFrame:
    """query_id, id, score, rank by cosine of (query_id, vector) with the index: the best in the probes nearest lists, or, exact, of all.

    own: whether a vector may be found for the question of the same id. Ties go to the smaller id; questions that usable() leaves out have no rows.
    """
    spark = questions.sparkSession
    known = [r for r in _centres(spark, path) if r.n]
    asked = usable(questions).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    if not known:
        return top(spark.createDataFrame([], "query_id bigint, id bigint, score double"), limit)
    centres, radii, lists = np.array([r.centre for r in known]), np.array([r.radius for r in known]), np.array([r.list for r in known], np.int32)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    def routed(rest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                products = _unit(batch["vector"]) @ centres.T
                near = np.argsort(-products, axis=1, kind="stable")[:, :probes]
                chosen = np.zeros(products.shape, bool)
                np.put_along_axis(chosen, near, True, 1)
                if rest:
                    reach = batch["reach"].fill_null(-2.0).to_numpy(zero_copy_only=False)[:, None]
                    least = np.maximum(0, np.arccos(np.clip(products, -1, 1)) - radii - SLACK)
                    chosen = ~chosen & (np.cos(np.minimum(least, np.pi)) + SLACK >= reach)
                row, at = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(row)), batch["vector"].take(pa.array(row)), pa.array(lists[at])], ["query_id", "vector", "list"])

        return run

    sent = "query_id bigint, vector array<double>, list int"
    first = written(_scored(written(asked.mapInArrow(routed(False), sent)), path, known, limit, own))
    if not exact:
        return top(first, limit)
    kth = top(first, limit).filter(F.col("rank") == limit).select("query_id", F.col("score").alias("reach"))
    more = written(asked.join(kth, "query_id", "left").mapInArrow(routed(True), sent))
    return top(first.union(_scored(more, path, known, limit, own)), limit)
