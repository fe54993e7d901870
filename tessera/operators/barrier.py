"""Columns that are computed once, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with further columns that the optimiser cannot put in place of their names: they come out of a generator of one row."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return rows.select(*rows.columns, made).select(*rows.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
