"""Report over request traces: a frame for each section, and the feedback that joins them.

Traces have trace_id, ts, endpoint, strategy, query_type, method, scores array<double>, retries, score_before,
score_after, risk, groundedness, claims, verifiable, supported, spans map<string,double>, error_type,
critic struct<invoked, failure_type, action, before_risk, after_risk, improved>, pii array<string>,
threats array<string>, output_threats array<string>; all may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranks
from tessera.operators.evaluation import histogram_bin


def volume(traces: DataFrame) -> DataFrame:
    return traces.groupBy(F.coalesce("endpoint", F.lit("?")).alias("endpoint")).agg(F.count("*").alias("n"), F.sum(F.col("error_type").isNotNull().cast("long")).alias("errors"))


def route_distribution(traces: DataFrame) -> DataFrame:
    """Counts by strategy and by query type in one pass over the traces."""
    routed = traces.filter(F.col("strategy").isNotNull())
    sets = routed.groupingSets([[F.col("strategy")], [F.col("query_type")]], "strategy", "query_type")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def decomposition(traces: DataFrame) -> DataFrame:
    return traces.filter("query_type = 'comparison'").groupBy("method").agg(F.count("*").alias("n"))


def rerank_top1(traces: DataFrame) -> DataFrame:
    top1 = traces.select(F.get("scores", F.lit(0)).alias("s")).filter(F.col("s").isNotNull())
    names = {f"p{p}": p for p in (10, 25, 50, 75, 90, 99)}
    found = ranks.percentiles(top1, [], "s", names, {"mean": F.round(F.avg("v"), 4)})
    return found.select("n", "mean", *[F.round(name, 6).alias(name) for name in names])


def rerank_histogram(traces: DataFrame) -> DataFrame:
    top1 = traces.select(F.get("scores", F.lit(0)).alias("s")).filter(F.col("s").isNotNull())
    return top1.groupBy(histogram_bin(F.col("s")).alias("bin")).agg(F.count("*").alias("n"))


def corrective(traces: DataFrame, threshold: float = 0.3) -> DataFrame:
    tried = F.coalesce(F.col("retries"), F.lit(0)) > 0
    gain = F.col("score_after") - F.col("score_before")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return traces.agg(F.count("*").alias("n"), count(tried).alias("triggered"), count(tried & (gain > 0)).alias("improved"), F.round(F.avg(F.when(tried, gain)), 6).alias("mean_gain"), count(F.coalesce("score_before", F.lit(0.0)) < threshold).alias("below"))


def verification(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("risk").isNotNull()).groupBy("risk").agg(F.count("*").alias("n"))


def groundedness(traces: DataFrame) -> DataFrame:
    wanted = {"p50": ranks.lower_rank(0.5), "p95": ranks.lower_rank(0.95), "least": F.lit(0)}
    return ranks.at_ranks(traces, [], "groundedness", wanted, {"mean": F.round(F.avg("v"), 4)})


def provenance(traces: DataFrame) -> DataFrame:
    return traces.agg(F.round(F.avg(F.when(F.col("claims") > 0, F.col("claims"))), 6).alias("claims_per_answer"), F.round(100.0 * F.sum("supported") / F.sum("verifiable"), 6).alias("supported_pct"))


def latency(traces: DataFrame) -> DataFrame:
    spans = traces.select(F.explode("spans").alias("span", "ms"))
    found = ranks.percentiles(spans, ["span"], "ms", {"p50": 50, "p95": 95})
    return found.select("span", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def errors(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("n"))


def critic(traces: DataFrame) -> DataFrame:
    """Transitions of risk by failure and action, most frequent first."""
    c = traces.filter("critic.invoked").select("critic.*")
    grouped = c.groupBy("failure_type", "action", "before_risk", "after_risk").agg(F.count("*").alias("n"), F.sum(F.col("improved").cast("long")).alias("improved"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "failure_type", "action", "before_risk", "after_risk")
    return grouped.withColumn("place", F.row_number().over(order))


def flags(traces: DataFrame, column: str) -> DataFrame:
    """Traces with each label of an array column, and their share of all."""
    total = traces.agg(F.count("*").alias("total"))
    labels = traces.select("trace_id", F.explode(F.array_distinct(column)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return labels.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def output_kinds(traces: DataFrame) -> DataFrame:
    kinds = traces.select(F.explode("output_threats").alias("t")).select(F.when(F.col("t").startswith("output_leak"), "leak").when(F.col("t").startswith("profanity"), "profanity").otherwise("other").alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def latest_by_id(traces: DataFrame, *order) -> DataFrame:
    """One trace for each id: the last in the given order."""
    w = Window.partitionBy("trace_id").orderBy(*order)
    return traces.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def feedback(signals: DataFrame, traces: DataFrame) -> DataFrame:
    """By signal and risk: feedback, how much of it meets a trace, and the mean first score of what does."""
    joined = signals.join(traces.select("trace_id", F.col("risk"), F.get("scores", F.lit(0)).alias("top1"), F.lit(True).alias("met")), "trace_id", "left")
    return joined.groupBy("signal").pivot("risk", ["pass", "warn", "soft_fail", "hard_fail"]).agg(F.count(F.lit(1))).join(
        joined.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("met", F.lit(False)).cast("int")), 3).alias("match_rate"), F.round(F.avg("top1"), 4).alias("mean_top1")), "signal"
    )


def load_summary(runs: DataFrame) -> DataFrame:
    """By concurrency: requests, rate and latency percentiles; and the level of the highest rate."""
    rate = runs.groupBy("concurrency").agg(F.count("*").alias("requests"), F.round(F.sum(F.col("ok").cast("long")) / F.max("wall_s"), 6).alias("qps"))
    times = ranks.at_ranks(runs, ["concurrency"], "ms", {f"p{p}": ranks.lower_rank(p / 100) for p in (50, 95, 99)}).drop("n")
    one = rate.join(times, "concurrency", "left")
    return one.crossJoin(F.broadcast(rate.agg(F.max_by("concurrency", F.struct("qps", -F.col("concurrency"))).alias("peak"))))
