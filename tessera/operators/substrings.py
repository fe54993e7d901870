"""Joins of texts with what they contain, by runs of characters in common instead of pairs of a key.

A needle is known by one of its runs of GRAM characters (all of it, if it is shorter), the one that the fewest needles of its key
have; a text by all of its runs. The needles' runs go to all tasks, in blocks of a bounded number, so of the texts' runs only
those that some needle of the key is known by are shuffled. What meets by key and run is then compared as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written

#: Characters of a run; different runs of needles that go to all tasks at once, about.
GRAM, MARKS = 8, 500_000


def runs(text: Column, n: int) -> Column:
    """The different runs of n characters, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def containing(texts: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tid, nid of every text (keys, tid, text) and needle (keys, nid, needle) of equal keys where the text has the needle in it.

    tid and nid tell rows of a key apart. A null is in nothing and has nothing; an empty needle is in every text that is not null.
    """
    needles = needles.filter(F.col("needle").isNotNull())
    size = F.least(F.length("needle"), F.lit(GRAM))
    sizes = sorted(r[0] for r in needles.select(size).distinct().collect())  # GRAM + 1 at most
    all_texts = texts.filter(F.col("text").isNotNull())
    found = all_texts.join(needles.filter("needle = ''"), keys).select(*keys, "tid", "nid")
    sizes = [n for n in sizes if n]
    if not sizes:
        return found
    own = F.coalesce(*[F.when(size == n, runs(F.col("needle"), n)) for n in sizes])
    each = needles.filter("needle <> ''").select(*keys, "nid", F.explode(own).alias("run"))
    each = each.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "run")))
    marks = written(each.groupBy(*keys, "nid").agg(F.min_by("run", F.struct("n", F.xxhash64("run"), "run")).alias("run")))
    held = all_texts.select(*keys, "tid", F.explode(F.concat(*[runs(F.col("text"), n) for n in sizes])).alias("run"))
    known = marks.select(*keys, "run").distinct()
    blocks = max(1, -(-known.count() // MARKS))
    parts = [held.join(F.broadcast(known.filter(F.pmod(F.xxhash64("run"), F.lit(blocks)) == i)), [*keys, "run"], "left_semi") for i in range(blocks)]
    met = reduce(DataFrame.union, parts).join(marks, [*keys, "run"]).select(*keys, "tid", "nid")
    both = met.join(needles, [*keys, "nid"]).join(texts, [*keys, "tid"]).filter(F.contains("text", "needle"))
    return found.union(both.select(*keys, "tid", "nid"))
