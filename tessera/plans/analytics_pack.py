"""Queries of the trace report, scoring, gates and status over events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import state
from tessera.operators import traces as tr
from tessera.plans.base import frame, table

#: A trace for each event; the text runs in Spark and elsewhere.
K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
TRACES = f"""
select event_id as trace_id, ts, user_id, case when event_id % 50 = 0 then null when event_id % 3 = 0 then 'retrieve' else 'answer' end as endpoint,
  case when event_id % 11 = 0 then null else event_type end as strategy, case k % 4 when 0 then 'comparison' when 1 then 'procedure' when 2 then 'interpretation' else 'simple_fact' end as query_type,
  case when k % 2 = 0 then 'none' else 'split' end as method, case when event_id % 13 = 0 then null else value / 100 end as top1, k % 3 as retries, case when event_id % 4 = 0 then null else value / 200 end as score_before, k / 100.0e0 as score_after,
  case k % 5 when 0 then 'hard_fail' when 1 then 'soft_fail' when 2 then 'warn' when 3 then 'pass' end as risk, case when k % 3 = 0 then null else cast(k as double) / 100 end as groundedness,
  k % 6 as claims, k % 6 as verifiable, k % 3 as supported, value as ms, case when event_type = 'error' then concat('kind', cast(k % 4 as string)) end as error_type,
  k % 7 = 0 as invoked, concat('f', cast(k % 3 as string)) as failure_type, concat('a', cast(event_id % 2 as string)) as action, concat('r', cast(k % 2 as string)) as before_risk, concat('r', cast(event_id % 3 as string)) as after_risk, event_id % 3 = 0 as improved,
  case when k % 8 = 0 then 'EMAIL' when k % 8 = 1 then 'PHONE' end as pii, case when k % 9 = 0 then 'output_leak:x' when k % 9 = 1 then 'profanity:y' end as threat, event_type, value, k
from (select *, {K} as k from events) e
"""


def traces(spark, sf_dir):
    t = frame(spark, sf_dir, TRACES)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return t.withColumns({
        "scores": one("top1"), "spans": F.create_map(F.lit("rerank"), F.col("ms"), F.lit("total"), F.col("ms") * 2), "pii": one("pii"), "output_threats": one("threat"),
        "critic": F.struct("invoked", "failure_type", "action", "before_risk", "after_risk", "improved"),
    })


def of(section, *more):
    return lambda spark, sf_dir: section(traces(spark, sf_dir), *more)


T = f"with t as ({TRACES}) "


def _pct(p):
    return f"round(case when count(s) < 100 then list_sort(list(s))[cast(least(count(s) - 1, floor(count(s) * {p} / 100)) as int) + 1] else quantile_cont(s, {p} / 100) end, 6) as p{p}"


def feedback(spark, sf_dir):
    signals = frame(spark, sf_dir, SIGNALS)
    return tr.feedback(signals, traces(spark, sf_dir))


SIGNALS = "select case when event_id % 10 = 9 then event_id + 100000000 else event_id end as trace_id, case event_type when 'purchase' then 'up' when 'error' then 'down' else 'reformulated' end as signal from events"
FEEDBACK_SQL = f"""{T}, f as ({SIGNALS}), j as (select f.signal, t.risk, t.top1, t.trace_id is not null as met from f left join t on f.trace_id = t.trace_id)
select signal, {', '.join(f"nullif(count(*) filter (risk = '{r}'), 0) as {r}" for r in ('pass', 'warn', 'soft_fail', 'hard_fail'))}, count(*) as n, round(avg(cast(met as int)), 3) as match_rate, round(avg(top1), 4) as mean_top1 from j group by signal"""


def latest(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("trace_id", F.col("trace_id") % 997)
    return tr.latest_by_id(t, F.col("ts"), F.col("value"), F.col("k")).select("trace_id", "ts", "value")


def load(spark, sf_dir):
    runs = frame(spark, sf_dir, "select cast(pow(2, event_id % 6) as int) as concurrency, event_type <> 'error' as ok, value as ms, 3.0e0 as wall_s from events")
    return tr.load_summary(runs)


LOAD_SQL = """
with r as (select cast(pow(2, event_id % 6) as int) as concurrency, event_type <> 'error' as ok, value as ms from events),
o as (select concurrency, count(*) as requests, round(count(*) filter (ok) / 3.0::double, 6) as qps, list_sort(list(ms)) as l from r group by 1)
select concurrency, requests, qps, """ + ", ".join(f"l[cast(least(len(l) - 1, floor(len(l) * {p / 100})) as int) + 1] as p{p}" for p in (50, 95, 99)) + ", (select concurrency from o order by qps desc, concurrency limit 1) as peak from o"


def scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    predicted = F.when(F.col("n_chars") > 3000, 1).when(F.col("n_chars") > 200, 0)
    expected = F.when(F.col("toxic") == 0, F.col("quality"))
    return ev.score_table(docs, expected, predicted, "lang")


SCORING_SQL = """
with d as (select lang, case when toxic = 0 then quality end as e, case when n_chars > 3000 then 1 when n_chars > 200 then 0 end as p from documents join labels using (doc_id)),
c as (select lang, count(*) filter (e is not null and e is not distinct from p) as tp, count(*) filter (e is not null and p is null) as fn, count(*) filter (p is not null and e is distinct from p) as fp, count(*) filter (e is null and p is null) as tn from d group by rollup (lang))
select *, round(case when tp + fp > 0 then tp / (tp + fp) else 1 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 1 end, 6) as recall from c
"""


def gate(spark, sf_dir):
    """Checks of each source's documents in long form, and the worst of each source."""
    d = table(spark, sf_dir, "documents")
    letters = F.regexp_count("text", F.lit("[a-zA-Z]")) / F.greatest(F.length("text"), F.lit(1))
    stats = d.groupBy("source").agg(F.avg(letters).alias("letters"), F.count("*").alias("n"), F.sum((F.length("text") > 1600).cast("int")).alias("long"), F.sum((F.col("text") == "").cast("int")).alias("blank"))
    verdict = lambda ok, warn: F.when(ok, "PASS").when(warn, "WARN").otherwise("FAIL")
    checks = stats.select("source", verdict(F.col("letters") >= 0.7, F.col("letters") >= 0.3).alias("a"), verdict((F.col("n") >= 5) & (F.col("n") <= 60), F.col("n") > 60).alias("b"), verdict(F.col("long") == 0, F.col("long") < F.col("n")).alias("c"), verdict(F.col("blank") == 0, F.lit(False)).alias("d"))
    long = checks.unpivot("source", ["a", "b", "c", "d"], "check", "verdict")
    return ev.worst(long, "source")


GATE_SQL = """
with s as (select source, avg(len(regexp_extract_all(text, '[a-zA-Z]')) / greatest(length(text), 1)) as letters, count(*) as n, count(*) filter (length(text) > 1600) as long, count(*) filter (text = '') as blank from documents group by source),
c as (select source, unnest([case when letters >= 0.7 then 'PASS' when letters >= 0.3 then 'WARN' else 'FAIL' end, case when n between 5 and 60 then 'PASS' when n > 60 then 'WARN' else 'FAIL' end, case when long = 0 then 'PASS' when long < n then 'WARN' else 'FAIL' end, case when blank = 0 then 'PASS' else 'FAIL' end]) as v from s)
select source, case when count(*) filter (v = 'FAIL') > 0 then 'FAIL' when count(*) filter (v = 'WARN') > 0 then 'WARN' else 'PASS' end as verdict, count(*) filter (v = 'PASS') as pass, count(*) filter (v = 'WARN') as warn, count(*) filter (v = 'FAIL') as fail from c group by source
"""


def regression(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    now = d.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    before = d.filter(F.col("event_type") != "error").groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("value"))
    return ev.gate_against(now, before, "event_type", "value")


def status_log(spark, sf_dir):
    return state.transitions(table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("to_status"), "ts", "event_id"))


def snapshot(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("to_status"), "ts", "event_id")
    codes = frame(spark, sf_dir, "select * from (values ('view', 'seen'), ('click', 'opened'), ('error', 'failed')) as c(status, status_name)")
    return state.with_names(state.snapshot(log), codes)


def upserted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return state.upsert(e.filter("event_id % 2 = 0").select("user_id", "ts", "event_id", "value"), e.filter("event_id % 2 = 1").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])


def backfilled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"), F.min("o_orderpriority").alias("segment"))
    return state.backfill(c, new, "c_custkey", ["balance", "segment"])


def unprocessed(spark, sf_dir):
    return state.unprocessed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def silver(spark, sf_dir):
    bronze = table(spark, sf_dir, "documents").select("doc_id", F.lit("bronze").alias("layer"), F.col("n_chars").cast("long").alias("size"))
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("silver").alias("layer"), F.col("quality").cast("long").alias("size")).dropDuplicates(["doc_id"])
    return state.processed_first(done, bronze, "doc_id")


def last_by_query(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n = 1").select("event_type", "user_id", "event_id")


QUERIES = {
    "ag1_volume": (of(tr.volume), T + "select coalesce(endpoint, '?') as endpoint, count(*) as n, count(error_type) as errors from t group by 1"),
    "ag2_route_distribution": (of(tr.route_distribution), T + "select strategy, query_type, count(*) as n, cast(grouping(strategy, query_type) as bigint) as level from t where strategy is not null group by grouping sets ((strategy), (query_type))"),
    "ag3_decomposition": (of(tr.decomposition), T + "select method, count(*) as n from t where query_type = 'comparison' group by method"),
    "ag4_rerank_top1": (of(tr.rerank_top1), T + f", s as (select top1 as s from t where top1 is not null) select count(*) as n, round(avg(s), 4) as mean, {', '.join(_pct(p) for p in (10, 25, 50, 75, 90, 99))} from s"),
    "ag4_rerank_histogram": (of(tr.rerank_histogram), T + "select cast(least(greatest(floor(top1 / 0.1::double), 0), 9) as int) as bin, count(*) as n from t where top1 is not null group by 1"),
    "ag5_corrective": (of(tr.corrective), T + "select count(*) as n, count(*) filter (retries > 0) as triggered, count(*) filter (retries > 0 and score_after - score_before > 0) as improved, round(avg(score_after - score_before) filter (retries > 0), 6) as mean_gain, count(*) filter (coalesce(score_before, 0) < 0.3) as below from t"),
    "ag6_verification": (of(tr.verification), T + "select risk, count(*) as n from t where risk is not null group by risk"),
    "ag6_groundedness": (of(tr.groundedness), T + ", g as (select list_sort(list(groundedness)) as l, avg(groundedness) as m from t where groundedness is not null) select cast(len(l) as bigint) as n, round(m, 4) as mean, l[cast(floor(len(l) * 0.5) as int) + 1] as p50, l[cast(floor(len(l) * 0.95) as int) + 1] as p95, l[1] as least from g"),
    "ag7_provenance": (of(tr.provenance), T + "select round(avg(claims) filter (claims > 0), 6) as claims_per_answer, round(100.0::double * sum(supported) / sum(verifiable), 6) as supported_pct from t"),
    "ag8_latency": (of(tr.latency), T + f", s as (select 'rerank' as span, ms as s from t union all select 'total', ms * 2 from t) select span, count(*) as n, {_pct(50)}, {_pct(95)} from s group by span"),
    "ag9_errors": (of(tr.errors), T + "select error_type, count(*) as n from t where error_type is not null group by 1"),
    "ag10_critic": (of(tr.critic), T + ", g as (select failure_type, action, before_risk, after_risk, count(*) as n, cast(sum(improved::int) as bigint) as improved from t where invoked group by 1, 2, 3, 4) select *, cast(row_number() over (order by n desc, failure_type, action, before_risk, after_risk) as int) as place from g"),
    "ag11_input_guard": (of(tr.flags, "pii"), T + "select pii as label, count(*) as n, round(count(*) / (select count(*) from t), 6) as rate from t where pii is not null group by pii"),
    "ag12_output_guard": (of(tr.output_kinds), T + "select case when starts_with(threat, 'output_leak') then 'leak' when starts_with(threat, 'profanity') then 'profanity' else 'other' end as kind, count(*) as n from t where threat is not null group by 1"),
    "ag13_feedback": (feedback, FEEDBACK_SQL),
    "j5_latest_trace": (latest, T + "select trace_id % 997 as trace_id, ts, value from t qualify row_number() over (partition by trace_id % 997 order by ts, value, k) = 1"),
    "ag25_load": (load, LOAD_SQL),
    "ag19_precision_recall": (scoring, SCORING_SQL),
    "ag35_gates": (gate, GATE_SQL),
    "q21_regression_gate": (regression, "with n as (select event_type, round(avg(value), 6) as now from events group by 1), b as (select event_type, round(quantile_cont(value, 0.5), 6) as before from events where event_type <> 'error' group by 1) select n.event_type, now, before, coalesce(now >= before - 1e-6, true) as passes from n left join b using (event_type)"),
    "w5_status_transitions": (status_log, "select user_id as document_id, event_id, lag(event_type) over w as from_status, event_type as to_status, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) over w) / 1e6, 3) as seconds from events window w as (partition by user_id order by ts, event_id)"),
    "w6_status_snapshot": (snapshot, "with s as (select user_id as document_id, event_type as status, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select s.document_id, s.status, s.ts, c.status_name from s left join (values ('view', 'seen'), ('click', 'opened'), ('error', 'failed')) as c(status, status_name) on s.status = c.status"),
    "sk3_upsert": (upserted, "select user_id, ts, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "sk8_backfill": (backfilled, "with n as (select o_custkey, max(o_totalprice) as b, min(o_orderpriority) as s from orders group by 1) select c_custkey, coalesce(case when c_custkey % 3 <> 0 then c_acctbal end, b) as balance, coalesce(nullif(case when c_custkey % 4 = 0 then '' else c_mktsegment end, ''), s) as segment from customer left join n on c_custkey = o_custkey"),
    "j6_unprocessed": (unprocessed, "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "sc14_processed_first": (silver, "select d.doc_id, case when l.doc_id is not null then 'silver' else 'bronze' end as layer, coalesce(cast(l.quality as bigint), d.n_chars) as size from documents d left join labels l on d.doc_id = l.doc_id"),
    "n19_last_by_query": (last_by_query, "select event_type, user_id, event_id from events qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1"),
}
