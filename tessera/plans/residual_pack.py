"""Queries of smaller operators: names, sets, catalogues, maps of exclusions, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routing, text
from tessera.operators import evaluation as ev
from tessera.operators import retrieval, service, structure, verify
from tessera.plans.base import frame, table
from tessera.plans.structure_pack import _CLAUSES, MARKDOWN, lines

TABLES_2 = "select p_partkey as doc, 1 as pos, concat('| ', case p_partkey % 4 when 0 then '제자리암' when 1 then '경계성 종양' when 2 then '위암' else '기타' end, ' | C', cast(p_size + 10 as string), ' ~ C', cast(p_size + 20 as string), ', D', cast(p_size + 10 as string), '.1 |') as line from part"


def names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "../").otherwise("a/b/"), F.lit("file"), F.col("page_id").cast("string"), F.lit(".pdf"))
    masked = text.mask_same_length(F.concat(F.lit("의료법 제"), F.col("page_id").cast("string"), F.lit("조와 제2조")), structure.OTHER_LAW)
    return p.select("page_id", text.safe_name(path).alias("name"), F.length(masked).alias("masked_length"), masked.endswith("␡와 제2조").alias("kept"), F.size(text.natural_key(path)).alias("parts"), text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("page_id").cast("string")).alias("point_id"))


NAMES_SQL = r"""
with p as (select page_id, case when page_id % 5 = 0 then '../' else 'a/b/' end || 'file' || page_id || '.pdf' as path, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(cast(page_id as varchar))) as h from pages)
select page_id, case when page_id % 5 <> 0 then 'file' || page_id || '.pdf' end as name, cast(length('의료법 제' || page_id || '조와 제2조') as int) as masked_length, page_id is null as kept, cast(len(regexp_extract_all(path, '\d+|\D+')) as int) as parts,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast(instr('0123456789abcdef', substr(h, 17, 1)) - 1 as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from p
""".replace("page_id is null as kept", "true as kept")


def sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("given"), F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("wanted"))
    return ev.set_scores(e, F.col("given"), F.col("wanted"))


SETS_SQL = """
with s as (select user_id, coalesce(list(distinct event_type) filter (event_id % 2 = 0), []) as g, coalesce(list(distinct event_type) filter (value > 60), []) as w from events group by user_id),
c as (select cast(sum(len(list_intersect(g, w))) as bigint) as tp, cast(sum(len(list_filter(w, lambda x: not list_contains(g, x)))) as bigint) as fn, cast(sum(len(list_filter(g, lambda x: not list_contains(w, x)))) as bigint) as fp, count(*) filter (len(list_filter(w, lambda x: not list_contains(g, x))) = 0) as complete, count(*) as n from s)
select *, round(case when tp + fp > 0 then tp / (tp + fp) else 1 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 1 end, 6) as recall from c
"""


def catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return ev.catalogue(p.select(F.col("p_type").alias("name")).union(p.select(F.replace("p_type", F.lit(" "), F.lit("")))).union(p.select(F.concat(F.lit(" "), "p_brand"))))


def included(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return ev.must_include(p.select(F.col("p_brand").alias("doc"), F.substring("p_type", 1, 4).alias("name")), p.select(F.col("p_brand").alias("doc"), F.col("p_type").alias("name")))


def excluded(spark, sf_dir):
    return structure.exclusion_map(structure.clauses(lines(spark, sf_dir))).withColumn("run", F.col("run").cast("long"))


def reasons(spark, sf_dir):
    return structure.exclusion_reasons(structure.clauses(lines(spark, sf_dir))).select("doc", F.array_join("reasons", ",").alias("reasons"))


def ranges(spark, sf_dir):
    return structure.coverage_ranges(frame(spark, sf_dir, TABLES_2), routing.COVERAGE_HINTS)


RANGES_SQL = rf"select doc, pos, coverage, code_token from (select doc, pos, case when contains(split_part(line, '|', 2), '제자리암') then '제자리암진단자금' when contains(split_part(line, '|', 2), '경계성') then '경계성종양진단자금' when contains(split_part(line, '|', 2), '암') then '암진단자금' end as coverage, unnest(regexp_extract_all(split_part(line, '|', 3), '[CD]\d{{2}}(?:\.\d)?(?:\s*[~\-]\s*[CD]\d{{2}}(?:\.\d)?)?')) as code_token from ({TABLES_2})) where coverage is not null"


def lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(text.token_count(F.col("text"))), 6).alias("avg_len"))


HITS = "select o_custkey % 100 as query_id, o_orderkey as id, round(o_totalprice / 600000, 6) as score from orders where o_custkey % 7 > 0"


def enough(spark, sf_dir):
    asked = frame(spark, sf_dir, "select distinct c_custkey % 120 as query_id from customer")
    return retrieval.sufficient(frame(spark, sf_dir, HITS), asked)


ENOUGH_SQL = f"with b as (select query_id, max(score) as top1 from ({HITS}) group by 1), a as (select distinct c_custkey % 120 as query_id from customer) select a.query_id, top1, coalesce(top1 >= 0.3, false) as enough from a left join b on a.query_id = b.query_id"
TABLE_LINES = "select o_custkey % 200 as doc, o_orderkey as pos, case o_orderkey % 5 when 0 then concat('| ', o_orderstatus, ' |') when 1 then '|---|' when 2 then case when o_custkey % 3 = 0 then '| a | b |' else ' | one | ' end when 3 then '| x |' else case when o_custkey % 4 = 0 then 'text' else '|  y  |' end end as line from orders"


def junk(spark, sf_dir):
    return structure.junk_tables(frame(spark, sf_dir, TABLE_LINES)).withColumn("segment", F.col("segment").cast("long"))


JUNK_SQL = r"""
with l as (select *, trim(line) as s, starts_with(trim(line), '|') and ends_with(trim(line), '|') as t from (""" + TABLE_LINES + r""")),
c as (select *, coalesce(cast(t <> lag(t) over (partition by doc order by pos) as int), 0) as ch from l), g as (select *, sum(ch) over (partition by doc order by pos) as segment from c),
x as (select *, regexp_replace(s, '^\|+|\|+$', '', 'g') as i from g where t)
select doc, cast(segment as bigint) as segment, bool_and(regexp_matches(i, '^[\s\-:]+$') or not contains(i, '|')) as junk from x group by 1, 2
"""


def pieces(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.size(text.sentence_parts(F.col("text"))).alias("sentences"), F.length(text.without_nul(F.concat("text", F.lit("\x00a\x00")))).alias("chars"))


PIECES_SQL = r"select doc_id, cast(len(list_filter(regexp_split_to_array(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: s <> '')) as int) as sentences, cast(length(text) + 1 as int) as chars from documents where text is not null"


def rendered(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_partkey") % 9).cast("int").alias("level"), F.col("l_returnflag").alias("content")))).alias("n"))
    return rows.select("l_orderkey", text.render_nodes(F.transform("n", lambda x: F.struct(x.level.alias("level"), x.content.alias("content")))).alias("text"))


RENDERED_SQL = "select l_orderkey, string_agg(case when l_partkey % 9 > 0 then repeat('#', cast(least(l_partkey % 9, 6) as int)) || ' ' else '' end || l_returnflag, chr(10) || chr(10) order by l_linenumber, l_partkey, l_returnflag) as text from lineitem group by 1"


def signals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(routing.signal(F.col("value") / 100).alias("signal")).agg(F.count("*").alias("n"), F.min(routing.context_budget(F.length("event_type") * 100)).alias("budget"))


SIGNALS_SQL = "select case when value / 100 >= 0.7 then 'up' when value / 100 >= 0.4 then 'reformulated' else 'down' end as signal, count(*) as n, cast(min(5888 - length(event_type) * 100) as int) as budget from events group by 1"
CLAIMS = "select c_custkey as id, concat('제', cast(c_custkey % 5 + 1 as string), '조에 따라 지급', chr(10), '근거 없는 말', chr(10), '제', cast(c_custkey % 3 + 2 as string), '조와 제', cast(c_custkey % 4 + 1 as string), '조 참조') as answer from customer"
SUPPORT = "select o_custkey as id, o_orderkey as chunk_id, concat('본문 제', cast(o_orderkey % 6 + 1 as string), '조 내용') as content from orders"


def provenance(spark, sf_dir):
    return verify.provenance(frame(spark, sf_dir, CLAIMS), frame(spark, sf_dir, SUPPORT)).select("id", "claim_no", "claim", F.array_join("chunk_ids", ",").alias("chunks"), (F.size("chunk_ids") > 0).alias("cited"))


PROVENANCE_SQL = f"""
with c as (select id, unnest(string_split(answer, chr(10))) as claim, generate_subscripts(string_split(answer, chr(10)), 1) - 1 as claim_no from ({CLAIMS})), r as (select distinct id, claim_no, unnest(regexp_extract_all(claim, '제(\\d+)조', 1)) as n from c),
m as (select r.id, claim_no, list_sort(list(distinct chunk_id)) as ids from r join ({SUPPORT}) s on s.id = r.id and contains(content, '제' || n || '조') group by 1, 2)
select c.id, cast(c.claim_no as int) as claim_no, claim, coalesce(array_to_string(ids, ','), '') as chunks, ids is not null as cited from c left join m on m.id = c.id and m.claim_no = c.claim_no
"""


def cited(spark, sf_dir):
    return service.citations(verify.provenance(frame(spark, sf_dir, CLAIMS), frame(spark, sf_dir, SUPPORT))).groupBy("id").agg(F.count("*").alias("n"))


QUERIES = {
    "pf5_sufficient": (enough, ENOUGH_SQL),
    "pf7_junk_tables": (junk, JUNK_SQL),
    "s8_pieces": (pieces, PIECES_SQL),
    "s19_rendered": (rendered, RENDERED_SQL),
    "q18_signals": (signals, SIGNALS_SQL),
    "j15_provenance": (provenance, PROVENANCE_SQL),
    "v15_citations": (cited, f"select id, count(*) as n from ({PROVENANCE_SQL}) where cited group by 1"),
    "s24_names_and_ids": (names, NAMES_SQL),
    "ag20_set_scores": (sets, SETS_SQL),
    "ag33_catalogue": (catalogue, r"with n as (select p_type as name from part union all select replace(p_type, ' ', '') from part union all select ' ' || p_brand from part), c as (select trim(regexp_replace(name, '\s+', ' ', 'g')) as name, regexp_replace(name, '\s', '', 'g') as k from n) select name from c qualify row_number() over (partition by k order by contains(name, ' ') desc, name) = 1"),
    "ag21_must_include": (included, "with r as (select p_brand as doc, substr(p_type, 1, 4) as name from part), c as (select p_brand as doc, list(distinct p_type) as names from part group by 1) select r.doc, count(*) as n, count(*) filter (len(list_filter(names, lambda x: contains(x, r.name))) > 0) as hits from r join c on r.doc = c.doc group by r.doc"),
    "d24_exclusion_map": (excluded, f"with {_CLAUSES}, x as (select r.doc, r.run, jo, min(case when contains(title, '지급사유') then jo end) over (partition by r.doc, run) as coverage_jo, regexp_matches(title, '면책') as g, not regexp_matches(title, '정의|준용|목적') and regexp_matches(body, '감액하여?\\s*지급') as d from r join b using (doc, pos)) select doc, cast(run as bigint) as run, coverage_jo, jo, case when g then 'general' else 'reduction' end as kind from x where g or d"),
    "d23_exclusion_reasons": (reasons, f"with {_CLAUSES} select r.doc, case when bool_or(contains(body, '고의로')) then '고의' else '' end as reasons from r join b using (doc, pos) where regexp_matches(title, '지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책') group by r.doc"),
    "d22_coverage_ranges": (ranges, RANGES_SQL),
    "ag38_heading_levels": (lambda s, d: structure.heading_levels(lines(s, d)), rf"with l as (select regexp_extract(line, '^(#{{1,6}})\s+.+$', 1) as h from ({MARKDOWN})) select cast(length(h) as int) as level, count(*) as n from l where h <> '' group by 1"),
    "d11_sections": (lambda s, d: structure.sections(lines(s, d)), rf"select doc, regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1) as name, pos as first_pos, lead(pos) over (partition by doc order by pos) - 1 as end_pos from ({MARKDOWN}) where regexp_matches(line, '^#{{1,6}}\s+.*특별약관$')"),
    "ag34_token_lengths": (lengths, r"select lang, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) as avg_len from documents group by lang"),
}
