"""Queries of quality measures over orders, line items, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routing, text
from tessera.operators import quality, retrieval
from tessera.operators import evaluation as ev
from tessera.plans.base import frame, table
from tessera.plans.text_pack import QUESTIONS, q

RANKS = "select o_orderkey as query_id, case when o_orderkey % 5 < 4 then o_orderkey % 7 + 1 + case when o_custkey % 2 = 0 then 0 else 2 end end as first, case when o_custkey % 2 = 0 then 'domain' else 'general' end as segment from orders"
RUNS = "select p_partkey as run, case when p_partkey % 7 > 0 then p_size / 50.0 end as recall_5, case when p_partkey % 5 > 0 then p_size / 48.0 end as recall_3, case when p_partkey % 4 = 0 then cast('NaN' as double) when p_partkey % 4 < 3 then p_partkey % 100 / 100.0 end as faithfulness, case when p_partkey % 3 > 0 then p_partkey % 90 / 90.0 end as relevancy, p_partkey % 6 = 0 as biased from part"
IMAGES = "select l_orderkey as doc, l_linenumber as image, case l_partkey % 6 when 0 then '' when 1 then 'short' when 2 then '........... ---' when 3 then '12 + 34 = 46, 57' when 4 then '가나다라 plain words ' else '§§§§§§§§§§§§§§ a ★★★★★★' end as content, l_suppkey % 4 > 0 as done, l_discount * 10 as a, l_tax * 10 as b from lineitem"
PICTURES = "select l_orderkey as doc, l_linenumber as image, l_suppkey % 9 > 0 as present, cast(l_partkey * 3 as bigint) as size, l_partkey % 1500 + 5 as width, l_suppkey % 100 * 9 + 5 as height, l_quantity as stddev from lineitem"
CHUNKS = "select o_custkey % 40 as grp, o_orderkey as id, case o_orderkey % 5 when 0 then '제1장 > 기준으로 합니다.' when 1 then '제3조 지급합니다.' when 2 then '' else concat('a > b', o_orderstatus) end as heading_path, concat(o_comment_, case o_orderkey % 7 when 0 then ' ![x](y.png)' when 1 then ' <!-- page:3 -->' when 2 then ' ..... 9' when 3 then ' a<BR/>b' else '' end) as content from (select *, cast(o_totalprice as string) as o_comment_ from orders)"


def _one(spark, sf_dir, sql):
    return frame(spark, sf_dir, sql)


def gap(spark, sf_dir):
    measures = ev.recall_and_mrr(_one(spark, sf_dir, RANKS), "segment").filter("segment is not null")
    return quality.segment_gap(measures)


GAP_SQL = f"""
with m as (select segment, round(avg(coalesce(cast(first <= 1 as int), 0)), 6) as r, round(avg(coalesce(1.0 / first, 0)), 6) as m from ({RANKS}) group by 1),
g as (select max(r) filter (segment = 'general') - max(r) filter (segment = 'domain') as a, max(m) filter (segment = 'general') - max(m) filter (segment = 'domain') as b from m)
select round(a, 6) as recall_gap, round(b, 6) as mrr_gap, case when a >= 0.1 and b >= 0.1 then 'weaker' when a <= -0.1 or b <= -0.1 then 'stronger' else 'even' end as verdict from g
"""

DIAGNOSE_SQL = f"""
with r as (select run, coalesce(recall_5 >= 0.95, false) or coalesce(recall_3 >= 0.90, false) as enough, recall_5 is null and recall_3 is null as unknown, faithfulness is not null and not isnan(faithfulness) as f, relevancy is not null and not isnan(relevancy) as v, faithfulness, relevancy, biased from ({RUNS})),
w as (select *, (f or v) and not biased as measured, (f and faithfulness < 0.8) or (v and relevancy < 0.8) as weak from r),
d as (select run, case when unknown then 'unknown' when not enough then 'retrieval-bound' when measured and weak then 'generation-bound' when weak then 'generation-leaning' when measured then 'healthy' else 'unknown' end as verdict from w)
select run, verdict, case verdict when 'retrieval-bound' then 'conditional' when 'generation-bound' then 'open' when 'healthy' then 'closed' else 'blocked' end as gate from d
"""


def routes(spark, sf_dir):
    own = _one(spark, sf_dir, QUESTIONS).withColumns({"strategy": routing.classify(F.col("question")).strategy, "wanted": F.when(F.col("id") % 3 == 0, "hybrid").when(F.col("id") % 3 == 1, "dense_heavy").otherwise("bm25_heavy"), "segment": routing.segment(F.col("question"))})
    return quality.accuracy(own, F.col("wanted"), F.col("strategy"), "segment")


_RX = lambda p: f"regexp_matches(question, {q(p)})"
_SEG = "case when " + " or ".join(f"contains(question, {q(w)})" for w in routing.SEGMENT) + " then 'domain' else 'general' end"
ROUTES_SQL = f"""
with a as (select id, {_RX(routing.STRUCTURED)} as s, {_RX(routing.PROCEDURE_STRONG)} or ({_RX(routing.PROCEDURE_WEAK)} and not {_RX(routing.INTERPRETATION_FIRST)}) or {_RX(routing.COMPARISON)} or {_RX(routing.INTERPRETATION)} as m, {_SEG} as segment from ({QUESTIONS})),
b as (select segment, case id % 3 when 0 then 'hybrid' when 1 then 'dense_heavy' else 'bm25_heavy' end = case when s and not m then 'bm25_heavy' when m and not s then 'dense_heavy' else 'hybrid' end as ok from a)
select segment, count(*) as n, cast(count(*) filter (ok) as bigint) as hits, round(count(*) filter (ok) / count(*), 6) as accuracy from b group by rollup (segment)
"""


def segments(spark, sf_dir):
    return _one(spark, sf_dir, QUESTIONS).groupBy(routing.segment(F.col("question")).alias("segment")).agg(F.count("*").alias("n"))


def latency(spark, sf_dir):
    return quality.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


LATENCY_SQL = """
with r as (select event_type, value as v, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, round(avg(v), 6) as mean, min(v) as least, round((max(v) filter (k = (n + 1) // 2) + max(v) filter (k = n // 2 + 1)) / 2, 6) as median, max(v) filter (k = least(n, cast(floor(n * 0.95) as bigint) + 1)) as p95 from r group by 1
"""
ANSWERS = "select o_custkey % 25 as doc, o_orderkey % 3 as retries, o_totalprice / 1000 as seconds, case o_orderkey % 6 when 0 then '확인되지 않음' when 1 then '관련 내용을 찾지 못했습니다.' else o_orderstatus end as answer from orders"


def stats(spark, sf_dir):
    return quality.basic_stats(_one(spark, sf_dir, ANSWERS), "doc")


STATS_SQL = f"select doc, count(*) as n, cast(count(*) filter (contains(answer, '확인되지 않음') or contains(answer, '찾지 못했습니다')) as bigint) as refusals, cast(count(*) filter (retries > 0) as bigint) as retried, round(avg(seconds), 6) as mean_s, min(seconds) as least_s, max(seconds) as most_s from ({ANSWERS}) group by 1"


def _images(spark, sf_dir):
    scores = F.when(F.col("done"), F.array(F.col("a").cast("double"), F.col("b").cast("double")))
    return _one(spark, sf_dir, IMAGES).select("doc", "image", "content", scores.alias("scores"))


def recognition(spark, sf_dir):
    return quality.recognition_stats(_images(spark, sf_dir))


RECOGNITION_SQL = f"""
with i as (select doc, done, cast(a as double) as a, cast(b as double) as b, trim(content) as s from ({IMAGES})),
v as (select *, case when not done then null when s = '' then 'empty' when length(s) < 10 then 'too_short' when not regexp_matches(s, '[가-힣a-zA-Z0-9]') then 'special_only' when regexp_matches(s, '^[\\d\\s+\\-*/=().,^%<>]+$') then 'math_noise'
  when len(regexp_extract_all(s, '[가-힣a-zA-Z]')) / length(regexp_replace(s, '\\s', '', 'g')) < 0.3 then 'low_lang_ratio' else 'passed' end as v from i),
c as (select doc, count(*) as images, count(v) as recognised, {", ".join(f"cast(coalesce(sum(cast(v = '{x}' as bigint)), case when count(v) > 0 then 0 end) as bigint) as {x}" for x in ("passed", "empty", "too_short", "special_only", "math_noise", "low_lang_ratio"))} from v group by 1),
s as (select doc, unnest([a, b]) as s from i where done)
select c.*, r.* exclude doc from c left join (select doc, {", ".join(f"cast(count(*) filter (s >= {a} and s < {b}) as bigint) as {n}" for a, b, n in ((0.9, 1.01, "from_90"), (0.8, 0.9, "from_80"), (0.5, 0.8, "from_50"), (0.0, 0.5, "below_50")))}, round(avg(s), 6) as mean_score from s group by 1) r on c.doc = r.doc
"""


def worst(spark, sf_dir):
    own = _images(spark, sf_dir).filter(F.col("scores").isNotNull() & (text.ocr_verdict(F.col("content")) == "passed")).withColumn("mean", F.round((F.get("scores", F.lit(0)) + F.get("scores", F.lit(1))) / 2, 6))
    return quality.lowest(own.withColumn("grp", F.col("doc") % 50).select("grp", "doc", "image", "mean"), ["grp"], ["mean", "doc", "image"], 5)


WORST_SQL = f"select doc % 50 as grp, doc, image, round((cast(a as double) + cast(b as double)) / 2, 6) as mean, cast(row_number() over (partition by doc % 50 order by round((cast(a as double) + cast(b as double)) / 2, 6), doc, image) as int) as rank from ({IMAGES}) where done and content = '가나다라 plain words ' qualify rank <= 5"
PRUNE_SQL = f"""select case when not present then 'not_exists' when size < 100 then 'file_size' when width < 10 or height < 10 then 'too_small' when width < 400 or height < 300 then 'below_min' when width / height >= 10 then 'too_wide' when height / width >= 10 then 'too_tall'
 when width > 7000 or height > 7000 then 'too_large' when stddev > 0 and stddev < 10 then 'flat' else 'ok' end as reason, count(*) as n from ({PICTURES}) group by 1"""


def chunks(spark, sf_dir):
    return quality.chunk_quality(_one(spark, sf_dir, CHUNKS), "grp")


_LEAF = "trim(coalesce(string_split(heading_path, ' > ')[-1], ''))"
CHUNKS_SQL = rf"""select grp, count(*) as n, {", ".join(f"cast(count(*) filter (regexp_matches(content, '{p}')) as bigint) as {n}" for n, p in (("img", r"!\[[^\]]*\]\("), ("page", r"<!--\s*page"), ("dots", r"\.{4,}|·{4,}|…{3,}"), ("br", r"(?i)<br\s*/?>")))},
 cast(count(*) filter (regexp_matches({_LEAF}, '{quality.FRAGMENT_TAIL}') and not regexp_matches({_LEAF}, '{quality.STRUCTURE_MARK}')) as bigint) as frag from ({CHUNKS}) group by 1"""

GOLDEN = "select p_partkey as part, case p_partkey % 3 when 0 then 'brand' when 1 then 'size' else 'other' end as field, case p_partkey % 3 when 0 then p_brand when 1 then cast(p_size + p_partkey % 2 as string) end as expected from part"


def golden(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    rows = quality.answers_by_field(wide, _one(spark, sf_dir, GOLDEN), "part", ["brand", "size"])
    return quality.accuracy(rows, F.col("expected"), F.col("predicted"), "field")


GOLDEN_SQL = f"""with r as (select field, expected is not distinct from case field when 'brand' then p_brand when 'size' then cast(p_size as varchar) end as ok from ({GOLDEN}) g join part on p_partkey = g.part)
select field, count(*) as n, cast(count(*) filter (ok) as bigint) as hits, round(count(*) filter (ok) / count(*), 6) as accuracy from r group by rollup (field)"""


def anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    hits = docs.select((F.col("doc_id") % 50).alias("query_id"), "doc_id", F.col("text").alias("content"))
    hits = hits.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy("doc_id")))
    return quality.anchor_ranks(hits, _one(spark, sf_dir, ANCHORS))


ANCHORS = "select doc_id % 50 as query_id, replace(substr(text, 1, 12), ' ', '') as anchor from documents where doc_id % 7 = 3 and length(text) > 40"
ANCHORS_SQL = rf"""
with h as (select doc_id % 50 as query_id, lower(regexp_replace(text, '\s', '', 'g')) as t, row_number() over (partition by doc_id % 50 order by doc_id) as rank from documents where text is not null),
a as (select query_id, list(lower(regexp_replace(anchor, '\s', '', 'g'))) as xs from ({ANCHORS}) group by 1)
select h.query_id, cast(min(case when len(list_filter(xs, lambda x: contains(t, x))) > 0 then rank end) as int) as first from h join a using (query_id) group by 1
"""


def either_way(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    wanted = p.filter("id % 3 = 0").withColumn("name", F.when(F.col("id") % 2 == 0, F.substring("name", 1, 5)).otherwise(F.concat("name", F.lit(" X"))))
    return quality.first_either_way(wanted, p.filter("id % 3 = 1").select("brand", F.col("id").alias("ord"), "name"), "brand")


EITHER_SQL = """
with p as (select p_brand as brand, p_partkey as id, p_type as name from part), w as (select brand, id, case when id % 2 = 0 then substr(name, 1, 5) else name || ' X' end as name from p where id % 3 = 0),
r as (select brand, id as ord, name as rule from p where id % 3 = 1)
select w.brand, w.id, w.name, min(case when contains(rule, name) or contains(name, rule) then ord end) as ord, arg_min(rule, ord) filter (contains(rule, name) or contains(name, rule)) as rule from w left join r on w.brand = r.brand group by 1, 2, 3
"""

QUERIES = {
    "ag15_segment_gap": (gap, GAP_SQL),
    "q19_diagnose": (lambda s, d: quality.diagnose(_one(s, d, RUNS)), DIAGNOSE_SQL),
    "ag23_routing_accuracy": (routes, ROUTES_SQL),
    "q20_segments": (segments, f"select {_SEG} as segment, count(*) as n from ({QUESTIONS}) group by 1"),
    "ag24_latency_summary": (latency, LATENCY_SQL),
    "ag28_basic_stats": (stats, STATS_SQL),
    "ag26_recognition_stats": (recognition, RECOGNITION_SQL),
    "t5_worst_images": (worst, WORST_SQL),
    "ag27_prune_breakdown": (lambda s, d: quality.prune_breakdown(_one(s, d, PICTURES)), PRUNE_SQL),
    "pf8_chunk_quality": (chunks, CHUNKS_SQL),
    "n9_golden_by_field": (golden, GOLDEN_SQL),
    "j10_anchor_ranks": (anchors, ANCHORS_SQL),
    "j11_first_either_way": (either_way, EITHER_SQL),
}
