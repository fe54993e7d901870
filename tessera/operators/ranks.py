"""Order statistics of groups without sorting or gathering them: by counts of value ranges.

A first pass counts the values of each group in BINS ranges between its least and its highest; the range that holds a wanted
rank is known from running sums over at most BINS counts. Its values alone are counted in ranges again, until a range holds
one value, or FEW at most, which are then counted each. Only counts are shuffled, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written

#: Ranges that a group's values are counted in, and values that are few enough to be counted one by one.
BINS, FEW = 1024, 4096
_LARGEST = 1.7976931348623157e308


def _bin(v: str, lo: str, hi: str) -> Column:
    """Which range between lo and hi a value is in, in their order; the ends are ranges of their own.

    A span over zero is cut by sign and power of two, one over more than two powers in equal parts of the logarithm, others in equal parts.
    """
    x, a, b = (F.greatest(F.least(F.col(c), F.lit(_LARGEST)), F.lit(-_LARGEST)) for c in (v, lo, hi))
    power = lambda c: F.log2(F.abs(c))
    signed = F.coalesce(F.signum(x) * (F.floor(power(x)) + 1100), F.lit(0.0))
    along = lambda f: (f(x) - f(a)) / (f(b) - f(a))
    share = F.when(F.abs(power(b) - power(a)) > 2, along(lambda c: F.signum(a) * power(c))).otherwise(along(lambda c: c / 2))
    part = F.least(F.floor(share * BINS), F.lit(BINS - 2)).cast("double") + 1
    return F.when((a <= 0) & (b >= 0) & (a < b), signed).when(F.col(v) == F.col(lo), 0.0).when(F.col(v) == F.col(hi), float(BINS)).when(a < b, part).otherwise(1.0)


def _holding(counts: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """The range of counts (on, bin, c, lo, hi) that each target (k, name, rank, of those from before on) is in: k, name, rank, before, lo, hi, inside."""
    upto = F.sum("c").over(Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranges = counts.withColumn("upto", upto)
    found = targets.join(ranges, on).filter((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c")))
    return found.select("k", "name", "rank", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), "lo", "hi", F.col("c").alias("inside"))


def at_ranks(rows: DataFrame, keys: list[str], value: str, wanted: Mapping[str, Column], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """For each group: keys, n, measures, and for every name of wanted the value at that rank of the group's sorted values.

    wanted: ranks from 0 as Columns of n, the number of values; measures: further aggregates, of the values as column v. Nulls and
    NaN are no values; a group without values has no row, and without keys all rows are one group. A null key is a key.
    """
    v = F.col(value).cast("double")
    rows = rows.select(F.struct(*[F.col(c) for c in keys], F.lit(0).alias("_")).alias("k"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[c.alias(name) for name, c in (measures or {}).items()]))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in wanted.items()])
    targets = ends.select("k", F.explode(ranks).alias("t")).select("k", "t.name", "t.rank", F.lit(0).cast("bigint").alias("before"))
    ranges = lambda held, *on: held.groupBy(*on, _bin("v", "lo", "hi").alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = written(_holding(ranges(rows.join(ends.select("k", "lo", "hi"), "k"), "k"), targets, ["k"]))
    while (most := found.filter("lo < hi").agg(F.max("inside")).first()[0]) is not None:
        spans = found.filter("lo < hi")
        held = rows.join(spans.select("k", "name", "lo", "hi"), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        if most <= FEW:
            counts = held.groupBy("k", "name", F.col("v").alias("bin")).agg(F.count("*").alias("c")).withColumns({"lo": F.col("bin"), "hi": F.col("bin")})
        else:
            counts = ranges(held, "k", "name")
        found = written(_holding(counts, spans.select("k", "name", "rank", "before"), ["k", "name"]).union(found.filter("lo = hi")))
    values = found.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in wanted])
    return ends.join(values, "k").select(*[F.col("k")[c].alias(c) for c in keys], "n", *(measures or {}), *wanted)


def lower_rank(share: float) -> Column:
    """The rank int(n * share), or the last."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * share))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: Mapping[str, float], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """The report's percentiles of each group: the value at the nearest lower rank under a hundred values, between two ranks from there on.

    shares: in hundredths, by name. Returns keys, n, measures and the names.
    """
    n = F.col("n")
    place = lambda p: F.when(n < 100, F.least(n - 1, F.floor(n * p / 100)).cast("double")).otherwise((n - 1) * (p / 100))
    wanted = {}
    for name, p in shares.items():
        wanted |= {f"{name}_low": F.floor(place(p)), f"{name}_high": F.ceil(place(p))}
    found = at_ranks(rows, keys, value, wanted, measures)

    def between(name: str, p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        return F.when(low == high, F.col(f"{name}_low")).otherwise((high - place(p)) * F.col(f"{name}_low") + (place(p) - low) * F.col(f"{name}_high"))

    return found.select(*keys, "n", *(measures or {}), *[between(name, p).alias(name) for name, p in shares.items()])
