"""The folder that the driver and the executors share, for rows that are read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; in local mode, where neither is set, one of its own that goes at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path(spark: SparkSession, what: str) -> str:
    """A new path in it."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The same rows as a table in it: the plan before them ends there, and lost executors cost nothing before it."""
    spark = rows.sparkSession
    place = path(spark, "rows")
    rows.write.parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows; those of fewer files than there are cores are dealt out by a key and written, as a file may be one task's."""
    files, cores = len(rows.inputFiles()), rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartition(4 * cores, key)) if 0 < files < cores else rows
