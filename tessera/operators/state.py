"""State of documents as append-only logs and derived tables: transitions, snapshots, upserts, backfills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def transitions(log: DataFrame) -> DataFrame:
    """document_id, event_id, from_status, to_status, seconds since the last transition, of rows in order of time."""
    w = Window.partitionBy("document_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return log.select("document_id", "event_id", F.lag("to_status").over(w).alias("from_status"), "to_status", F.round(seconds - F.lag(seconds).over(w), 3).alias("seconds"))


def snapshot(log: DataFrame) -> DataFrame:
    """The last status of each document; added up before the shuffle."""
    return log.groupBy("document_id").agg(F.max_by(F.struct("to_status", "ts"), F.struct("ts", "event_id")).alias("s")).select("document_id", F.col("s.to_status").alias("status"), "s.ts")


def with_names(statuses: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds the name of each status; codes are a table of a few rows by design, of which Spark checks the size."""
    return statuses.join(codes, "status", "left").select("document_id", "status", "ts", "status_name")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the latest in the given order, of both frames."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def backfill(rows: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that are null, or empty texts, from a second frame."""
    other = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    own = lambda c: F.nullif(F.col(c), F.lit("")) if rows.schema[c].dataType.simpleString() == "string" else F.col(c)
    return rows.join(other, key, "left").select(*[F.coalesce(own(c), f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def unprocessed(chunks: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    return chunks.join(contents, key, "left_anti")


def processed_first(silver: DataFrame, bronze: DataFrame, key: str) -> DataFrame:
    """Rows of silver where there are any, else of bronze."""
    names = [c for c in bronze.columns if c != key]
    other = silver.select(key, F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in names])
    return bronze.join(other, key, "left").select(key, *[F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in names])


def replace_documents(spark: SparkSession, rows: DataFrame, path: str, partition: str = "document_id") -> None:
    """Deletes and inserts by document: only the partitions of the given rows are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def checked(rows: DataFrame, **rules) -> DataFrame:
    """Rows whose columns meet all the given conditions; a query that meets one that doesn't fails with its name."""
    return reduce(lambda d, rule: d.filter(F.when(rule[1], F.lit(True)).otherwise(F.raise_error(F.lit(f"not valid: {rule[0]}")).cast("boolean"))), rules.items(), rows)


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, at: str, since, key: str) -> DataFrame:
    """Rows from a time on, the latest first, with their place in that order."""
    return rows.filter(F.col(at) >= F.lit(since)).orderBy(F.desc(at), key)
