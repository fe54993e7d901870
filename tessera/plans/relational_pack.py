"""Queries of the relational and streaming categories over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.base import frame, table
from tessera.streaming import windows

# SQL that Spark and any other engine run alike, by name.
SQL = {
    "rel_pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "rel_inner_joins": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name",
    "rel_left_outer": "select c_custkey, count(o_orderkey) as orders, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on c_custkey = o_custkey group by c_custkey",
    "rel_full_outer": "select coalesce(s_nationkey, c_nationkey) as nation, s, c from (select s_nationkey, count(*) as s from supplier group by s_nationkey) x full outer join (select c_nationkey, count(*) as c from customer group by c_nationkey) y on s_nationkey = c_nationkey",
    "rel_semi": "select p_partkey, p_brand from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)",
    "rel_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "rel_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rel_cube": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)",
    "rel_rollup": "select p_brand, p_size, count(*) as n from part group by rollup (p_brand, p_size)",
    "rel_distinct_aggregates": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "rel_ranks": "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as r, dense_rank() over (partition by o_orderpriority order by o_orderstatus) as d, cast(ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as int) as q from orders",
    "rel_frames": "select event_id, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 6) as s, lead(event_type) over (partition by user_id order by event_id) as nxt, round(max(value) over (partition by user_id order by event_id range between 100 preceding and 100 following), 6) as m from events",
    "rel_top_k_each": "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as n from customer) t where n <= 3",
    "rel_intersect": "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'",
    "rel_except": "select o_custkey as k from orders except select o_custkey from orders where o_totalprice > 100000",
    "rel_having_subquery": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select avg(n) from (select count(*) as n from orders group by o_custkey) t)",
    "rel_case_pivot": "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end) as f, sum(case when o_orderstatus = 'O' then 1 else 0 end) as o from orders group by o_orderpriority",
    "rel_date_parts": "select extract(year from ts) as y, extract(month from ts) as m, extract(hour from ts) as h, count(*) as n from events group by 1, 2, 3",
    "rel_self_join": "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "rel_scalar_functions": "select p_partkey, upper(p_brand) as u, length(p_name) as l, round(sqrt(p_retailprice), 6) as s, abs(p_size - 25) as a, coalesce(nullif(p_size % 5, 0), -1) as c, substr(p_type, 1, 3) as t, replace(p_name, 'a', '_') as r from part",
}


def _sql(text):
    return lambda spark, sf_dir: frame(spark, sf_dir, text)


def interval_join(spark, sf_dir):
    """Pairs of a purchase and clicks of the same user in the ten minutes before it: joined by ten-minute cells, not all with all."""
    e = table(spark, sf_dir, "events").withColumn("cell", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600))
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at"), F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell"))
    clicks = e.filter("event_type = 'click'").select("user_id", "cell", F.col("event_id").alias("click"), "ts")
    return buys.join(clicks, ["user_id", "cell"]).filter((F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - F.expr("interval 10 minutes"))).select("purchase", "click")


def approximate(spark, sf_dir):
    """Exact figures, and whether the approximate ones are as near as they promise: a deviation of 5 in a hundred (four of them), and ranks within one in a hundred."""
    rows = table(spark, sf_dir, "lineitem")
    # apart from each other: beside a distinct count, Spark would make a sketch for every part of a flag
    about = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.05).alias("about"), F.percentile_approx("l_quantity", 0.5, 10000).alias("middle"))
    exact = rows.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    own = about.join(exact, "l_returnflag")
    rows = rows.join(F.broadcast(own), "l_returnflag").groupBy("l_returnflag", "parts", "about").agg(F.avg((F.col("l_quantity") < F.col("middle")).cast("double")).alias("below"), F.avg((F.col("l_quantity") <= F.col("middle")).cast("double")).alias("upto"))
    return rows.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.2 * F.col("parts")).alias("parts_near"), ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("median_near"))


def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def _stream(make, mode="append"):
    def run(spark, sf_dir):
        events = windows.read(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events"))
        return windows.drain(make(events.withColumn("ts", F.col("ts").cast("timestamp"))), mode)

    return run


def _instant(make, mode="complete"):
    return lambda spark, sf_dir: _stream(make, mode)(spark, sf_dir)


def feedback_stream(spark, sf_dir):
    like = table(spark, sf_dir, "events")
    stream = lambda: windows.read(spark, f"{sf_dir}/event[s].parquet", like).withColumn("ts", F.col("ts").cast("timestamp"))
    signals = stream().filter("event_type = 'purchase'").withColumn("trace_id", F.col("event_id") - 1)
    return windows.drain(windows.late_feedback(stream().filter("event_type <> 'purchase'"), signals))


def feedback_so_far(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    signals = events.filter("event_type = 'purchase'").withColumn("trace_id", F.col("event_id") - 1)
    return windows.late_feedback_so_far(events.filter("event_type <> 'purchase'"), signals)


FEEDBACK_SQL = """
with s as (select event_id as signal_id, event_id - 1 as of_, ts as signalled from events where event_type = 'purchase'), t as (select event_id as trace_id, ts as traced, value from events where event_type <> 'purchase'),
w as (select least((select max(signalled) from s), (select max(traced) from t)) - interval 2 hours as passed)
select signal_id, trace_id, value from s left join t on of_ = trace_id and traced <= signalled and traced >= signalled - interval 1 hour where trace_id is not null or signalled < (select passed from w)
"""

STREAMS = {
    "st3_daily_windows": (_instant(lambda e: windows.tumbling(e).withColumn("start", F.date_format("start", "yyyy-MM-dd"))), "select strftime(ts, '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"),
    "st_sliding_windows": (_instant(lambda e: windows.sliding(e).withColumn("start", F.unix_seconds("start"))), "with w as (select unnest([0, 7200, 14400]) as o, cast(floor(epoch(ts) / 7200) * 7200 as bigint) as s from events) select s - o as start, count(*) as n from w group by 1"),
    "st_session_windows": (_instant(lambda e: windows.sessions(e).select("user_id", F.unix_micros("start").alias("start"), "n")), "with g as (select *, case when ts >= lag(ts) over w + interval 30 minutes or lag(ts) over w is null then 1 else 0 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as start, count(*) as n from s group by user_id, k"),
    "st2_latest_status": (_instant(lambda e: windows.latest(e).select("user_id", "event_type")), "select user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "st4_span_totals": (_instant(windows.span_totals), "select user_id, event_type, round(sum(value), 2) as ms, count(*) as n from events group by 1, 2"),
    "st_distinct_within": (_stream(lambda e: windows.distinct_within(e, ["event_id"]).select("event_id", "event_type")), "select distinct event_id, event_type from events"),
    "st_stateful_counts": (_stream(windows.running_counts, "update"), "select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id"),
    "st5_late_feedback": (feedback_stream, FEEDBACK_SQL),
    "st5_late_feedback_replayed": (feedback_so_far, FEEDBACK_SQL),
}

QUERIES = {name: (_sql(text), text) for name, text in SQL.items()} | {
    "rel_interval_join": (interval_join, "select p.event_id as purchase, c.event_id as click from events p join events c on p.user_id = c.user_id and p.event_type = 'purchase' and c.event_type = 'click' and c.ts <= p.ts and c.ts >= p.ts - interval 10 minutes"),
    "rel_approximate": (approximate, "select l_returnflag, count(distinct l_partkey) as parts, true as parts_near, true as median_near from lineitem group by 1"),
    "rel_json": (json_props, "with k as (select cast(json_extract(props, '$.k') as int) as k from events) select k % 10 as bucket, count(*) as n, cast(sum(k) as bigint) as total from k group by 1"),
} | STREAMS
