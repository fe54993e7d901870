"""Streams of events and traces: windows, late rows, latest states, joins of late feedback, and sinks that a repeated batch does not change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import path


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it gave; a batch that comes again overwrites itself."""
    spark = stream.sparkSession
    out, schema = path(spark, "stream"), stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "6 hours", step: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest(events: DataFrame) -> DataFrame:
    """Status log to snapshot: the last status of each document."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")


def span_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("ms"), F.count("*").alias("n"))


def late_feedback(traces: DataFrame, signals: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each signal with its trace, if that came within the time before it; signals without one come once the watermark has passed."""
    t = traces.withWatermark("ts", "2 hours").select(F.col("event_id").alias("trace_id"), F.col("ts").alias("traced"), "value")
    s = signals.withWatermark("ts", "2 hours").select(F.col("event_id").alias("signal_id"), F.col("trace_id").alias("of"), F.col("ts").alias("signalled"))
    on = (F.col("of") == F.col("trace_id")) & (F.col("traced") <= F.col("signalled")) & (F.col("traced") >= F.col("signalled") - F.expr(f"interval {within}"))
    return s.join(t, on, "left").select("signal_id", "trace_id", "value")


def late_feedback_so_far(traces: DataFrame, signals: DataFrame, within: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """What late_feedback() has given once all these rows have come in order of time: signals without a trace only from before the watermark.

    The watermark lies by the delay behind the earlier of the last signal and the last trace; a later signal may still meet a trace. Both
    sides meet by trace, so nothing but the two last times is the same for all.
    """
    t = traces.select(F.col("event_id").alias("trace_id"), F.col("ts").alias("traced"), "value")
    s = signals.select(F.col("event_id").alias("signal_id"), F.col("trace_id").alias("of"), F.col("ts").alias("signalled"))
    on = (F.col("of") == F.col("trace_id")) & (F.col("traced") <= F.col("signalled")) & (F.col("traced") >= F.col("signalled") - F.expr(f"interval {within}"))
    ends = [frame.agg(F.max("ts")).first()[0] for frame in (traces, signals)]
    passed = F.lit(None if None in ends else min(ends)).cast("timestamp") - F.expr(f"interval {delay}")
    return s.join(t, on, "left").filter(F.col("trace_id").isNotNull() | (F.col("signalled") < passed)).select("signal_id", "trace_id", "value")


def running_counts(events: DataFrame) -> DataFrame:
    """Rows of each user so far, with state of its own: user_id, n, last, given anew with each batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def task_chain(stream: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], failed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs every batch of documents through named steps in turn and returns the rows of each: step, and what it gave, as JSON.

    Each step's rows of a batch overwrite themselves if the batch comes again, so a chain that stops is taken up at the batch
    it was in. failed: rows that a step may not take (a condition by anti join), which go no further.
    """
    spark = stream.sparkSession
    out = path(spark, "stream")

    def run(batch: DataFrame, number: int) -> None:
        rows = batch
        for i, (name, step) in enumerate(steps):
            rows = step(rows if failed is None else failed(rows))
            path = f"{out}/{i:02d}-{name}/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    found = None
    for i, (name, _) in enumerate(steps):
        part = spark.read.parquet(f"{out}/{i:02d}-{name}")
        part = part.select(F.lit(name).alias("step"), F.to_json(F.struct(*[c for c in part.columns if c != "batch"])).alias("row"))
        found = part if found is None else found.union(part)
    return found
