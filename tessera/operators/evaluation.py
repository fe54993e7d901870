"""Measures of retrieval and extraction: recall, reciprocal rank, confusion, dispersion, precision, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rank(hits: DataFrame, relevant: Column) -> DataFrame:
    """query_id and the least rank of a relevant hit (null if none)."""
    return hits.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))


def recall_and_mrr(ranks: DataFrame, *by: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over questions, for all and for each value of the given columns (null: all)."""
    at = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}") for k in ks]
    grouped = ranks.rollup(*by) if by else ranks.groupBy()
    return grouped.agg(F.count("*").alias("n"), *at, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def confusion_rate(hits: DataFrame, allowed: Column, warn: float = 0.15) -> DataFrame:
    out = hits.agg(F.count("*").alias("hits"), F.sum((~allowed).cast("int")).alias("outside")).withColumn("rate", F.round(F.col("outside") / F.col("hits"), 6))
    return out.withColumn("warn", F.col("rate") >= warn)


def score_table(rows: DataFrame, expected: Column, predicted: Column, *by: str) -> DataFrame:
    """True and false positives and negatives, precision and recall (1 without cases), for all and by the given columns."""
    hit, wanted, given = expected.eqNullSafe(predicted), expected.isNotNull(), predicted.isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    out = rows.rollup(*by).agg(count(wanted & hit).alias("tp"), count(wanted & ~given).alias("fn"), count(given & ~hit).alias("fp"), count(~wanted & ~given).alias("tn"))
    ratio = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0), 6)
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def histogram_bin(value: Column, low: float = 0.0, width: float = 0.1, bins: int = 10) -> Column:
    """Bin on a fixed grid in doubles; what lies outside goes to the outer bins."""
    return F.least(F.greatest(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def gate_against(current: DataFrame, baseline: DataFrame, on: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Whether each measure is no worse than its baseline; without a baseline it passes."""
    both = current.select(on, F.col(value).alias("now")).join(baseline.select(on, F.col(value).alias("before")), on, "left")
    return both.withColumn("passes", F.coalesce(F.col("now") >= F.col("before") - eps, F.lit(True)))


def worst(verdicts: DataFrame, by: str) -> DataFrame:
    """PASS, WARN or FAIL of each group by its worst check."""
    level = F.max(F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "WARN", 1).otherwise(0))
    return verdicts.groupBy(by).agg(level.alias("level"), *[F.sum((F.col("verdict") == v).cast("long")).alias(v.lower()) for v in ("PASS", "WARN", "FAIL")]).select(by, F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.col("level") + 1).alias("verdict"), "pass", "warn", "fail")


def dispersion(vectors: DataFrame, group: str) -> DataFrame:
    """Mean and deviation of cosines between all pairs of a group's unit vectors, from sums alone: no pairs are made.

    The mean follows from the sum of the vectors, the mean square from the sum of their outer products, both
    of which are added up before they move.
    """
    n = F.count("*").alias("n")
    flat = vectors.select(group, "id", F.posexplode("vector").alias("i", "x"))
    sums = flat.groupBy(group, "i").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    squares = flat.groupBy(group, "id").agg(F.sum(F.col("x") * F.col("x")).alias("q")).groupBy(group).agg(n, F.sum("q").alias("qq"), F.sum(F.col("q") * F.col("q")).alias("qqqq"))
    outer = vectors.select(group, "vector").select(group, F.posexplode("vector").alias("i", "x"), "vector").select(group, "i", "x", F.posexplode("vector").alias("j", "y"))
    square = outer.groupBy(group, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("m")).groupBy(group).agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("ss") - F.col("qq")) / pairs
    mean_square = (F.col("mm") - F.col("qqqq")) / pairs
    return sums.join(squares, group).join(square, group).filter("n > 1").select(group, "n", F.round(mean, 6).alias("mean_cosine"), F.round(F.sqrt(F.greatest(mean_square - mean * mean, F.lit(0.0))), 6).alias("std_cosine"), (mean >= 0.85).alias("warn"))


def share_of_total(rows: DataFrame, by: str) -> DataFrame:
    everything = Window.partitionBy(F.lit(0))
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(everything), 4))


def set_scores(rows: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    """Sums over rows of what two sets share and lack, precision and recall, and rows whose expected set is all there."""
    size = lambda c: F.sum(F.size(c).cast("long"))
    out = rows.agg(size(F.array_intersect(predicted, expected)).alias("tp"), size(F.array_except(expected, predicted)).alias("fn"), size(F.array_except(predicted, expected)).alias("fp"), F.sum((F.size(F.array_except(expected, predicted)) == 0).cast("long")).alias("complete"), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0), 6)
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def catalogue(names: DataFrame) -> DataFrame:
    """Distinct names without regard to white space; of the spellings the one with a blank, then the first, stays."""
    tight = F.regexp_replace("name", r"\s", "")
    clean = F.regexp_replace(F.regexp_replace("name", r"\s+", " "), r"^\s+|\s+$", "")
    w = Window.partitionBy("key").orderBy(F.col("name").contains(" ").desc(), "name")
    return names.select(clean.alias("name"), tight.alias("key")).withColumn("n", F.row_number().over(w)).filter("n = 1").select("name")


def must_include(required: DataFrame, catalogue: DataFrame) -> DataFrame:
    """By document: how many required names are part of some name of its catalogue. required: doc, name; catalogue: doc, name."""
    held = catalogue.groupBy("doc").agg(F.collect_set("name").alias("names"))
    both = required.join(held, "doc", "left").withColumn("hit", F.coalesce(F.exists("names", lambda n: n.contains(F.col("name"))), F.lit(False)))
    return both.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
