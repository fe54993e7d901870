"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of output are sent on once they hold about so many bytes.
FLUSH_BYTES = 4 << 20
#: Left rows of a key, and their share of all, from which lookup() treats the key as hot.
HOT_ROWS, HOT_SHARE = 1000, 1e-4
#: Lets Spark delete the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D, which is what bytes.split() splits on.
WORD_SEPARATORS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a local one in local mode, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for files in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """The same rows as a written table in the shared folder: lineage ends there, so lost executors cost nothing before it, and the shuffles that led to it go."""
    spark = frame.sparkSession
    path = scratch(spark, "settled")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join with a settled right side of unique keys, of which n says how many left rows each may meet.

    Keys with more than HOT_ROWS and a HOT_SHARE of all n go to every task (at most 1 / HOT_SHARE rows), so left
    rows that meet one of them do not move (inner), or are dealt out by a hash of the columns spread (left);
    all others move by their keys.
    """
    others = [c for c in right.columns if c not in keys]
    bound = max(HOT_ROWS, (right.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE)
    hot, cold = right.filter(F.col(n) > bound), right.filter(F.col(n) <= bound)
    if hot.isEmpty():
        return left.join(right, keys, how).select(*left.columns, *others)
    if how == "inner":
        rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
        return left.join(F.broadcast(hot), keys).select(*left.columns, *others).union(rest.select(*left.columns, *others))
    hot = hot.select(*keys, F.struct(*others).alias("_hot"))
    cold = cold.select(*keys, F.struct(*others).alias("_cold"), F.lit(0).cast("bigint").alias("_salt"))
    met = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*spread)))
    joined = met.join(cold, [*keys, "_salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in others])


def sample_bound(n: int, wanted: int) -> int:
    """The 63-bit hashes below it are about wanted of n, never none in the long run: a bound in whole numbers, whatever n is."""
    return (1 << 63) - 1 if n <= wanted else max(1, (wanted << 63) // n)


def held_out(doc_id: str | Column, buckets: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % buckets == remainder, F.lit(False))


def text_bytes(name: str = "text") -> Column:
    """Text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under a name. It keeps one thing at a time: a worker that goes on to another operator lets go of what the last one kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def row_map(frame: DataFrame, schema: str, start: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]], arrow: pa.Schema) -> DataFrame:
    """Rows through a Python generator in Arrow batches.

    start() runs once in each task and returns a function from an iterable of row tuples to an
    iterable of (row tuple, bytes about). Memory holds one input batch and FLUSH_BYTES of output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [c for c in batch.columns]
                for i in range(0, batch.num_rows, 256):
                    yield from zip(*(c.slice(i, 256).to_pylist() for c in columns))

        held: list[tuple] = []
        size = 0
        for row, n in step(rows()):
            held.append(row)
            size += n + 64
            if size >= FLUSH_BYTES:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return frame.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


def column_map(frame: DataFrame, schema: str, start: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]], arrow: pa.Schema) -> DataFrame:
    """As row_map, for functions that yield a tuple of equally long numpy arrays (or lists) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    yield from zip(*(c.slice(i, 256).to_pylist() for c in batch.columns))

        held: list[tuple] = []
        size = 0
        for columns in step(rows()):
            held.append(columns)
            size += len(columns[0])
            if size >= 50_000:
                yield _joined(held, arrow)
                held, size = [], 0
        if held:
            yield _joined(held, arrow)

    return frame.mapInArrow(run, schema)


def _joined(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.chunked_array([pa.array(part, f.type) for part in column], f.type).combine_chunks() for column, f in zip(zip(*held), schema)], schema=schema)
