"""Queries of document structure over contracts in markdown made from orders, and of layout, positions and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking, structure
from tessera.plans.base import frame, table

#: Sixteen lines for each order; the text runs in Spark and elsewhere.
N = "cast({} as string)"
MARKDOWN = f"""
select o_orderkey as doc, v.pos as pos, case v.pos
  when 1 then concat('# 약관 ', {N.format('o_custkey')}) when 2 then '## 목 차' when 3 then '제1조(목적) ············ 3'
  when 4 then concat('##### 제', {N.format('o_orderkey % 2 + 1')}, '조(지급사유) 제3조와 별표 2 참조, 상법 제9조') when 5 then concat('본문 ', {N.format('o_custkey')}, ' 철회 가능일부터 15일 이내 철회, ', {N.format('o_custkey % 5 + 1')}, '년마다 갱신')
  when 6 then concat('- 제', {N.format('o_orderkey % 3 + 2')}, '조【면책 면책】 고의로 ') when 7 then '| 구분 | 90일 이하 | 90일 초과 1년 미만 | 1년 이상 |' when 8 then '|---|---|---|---|'
  when 9 then concat('| 레진 | 가입금액의 ', {N.format('o_orderkey % 50')}, '% | ', case when o_custkey % 2 = 0 then '가입금액의 50%' else '' end, ' | ', case when o_custkey % 4 = 0 then '가입금액의 100%' else '-' end, ' |')
  when 10 then case when o_custkey % 3 = 0 then '### 질병을 원인으로' else '◦ 상해를 원인으로' end when 11 then concat('| 12개월 급여 | 사유 ', {N.format('o_custkey % 90')}, '일 한도 | 가입금액의 1.5% 매월 상기 금액의 50%, 1년이 지난 전일 이전 재해 이외 |')
  when 12 then '## 특별약관' when 13 then '제1조(총칙(가)) 별표 3' when 14 then '(별표3) 악성신생물 분류표' when 15 then concat('<!-- page:', {N.format('o_custkey % 30')}, ' --> 보장대상이 되는 것') else concat('- C15 ~ C26, D', {N.format('o_orderkey % 50 + 10')}) end as line
from orders cross join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16)) as v(pos)
"""
#: Orders whose lines a task sorts, about half a million.
ORDERS_A_TASK = 32768
NODES = "select l_orderkey as doc, l_linenumber % 2 as page, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 as id, cast(l_suppkey % 5 * 45 as double) as x0, l_extendedprice as y1 from lineitem"
B = " over (partition by doc order by pos rows between unbounded preceding and current row)"
_S = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_TOC = r"regexp_matches(title, '(?i)^(목\s*차|차\s*례|table\s+of\s+contents|contents)$')"


def lines(spark, sf_dir):
    return frame(spark, sf_dir, MARKDOWN)


def paths(spark, sf_dir):
    return structure.running_page(structure.heading_paths(lines(spark, sf_dir))).select("doc", "pos", "level", "path", "page")


PATHS_SQL = (
    rf"with l as (select doc, pos, line, case when regexp_matches({_S}, '^(#{{1,6}})\s+(.+)$') then length(regexp_extract({_S}, '^(#{{1,6}})\s+', 1)) end as level, regexp_extract({_S}, '^#{{1,6}}\s+(.+)$', 1) as title from ({MARKDOWN})),"
    + " h as (select *, " + ", ".join(f"last_value(case when level = {i} then pos end ignore nulls){B} as p{i}, last_value(case when level = {i} then title end ignore nulls){B} as t{i}" for i in range(1, 7)) + f", last_value(try_cast(nullif(regexp_extract(line, '^<!-- page:(\\d+) -->', 1), '') as int) ignore nulls){B} as page from l)"
    + " select doc, pos, cast(level as int) as level, array_to_string(list_filter([" + ", ".join(f"case when p{i} > greatest(-1, " + ", ".join(f"coalesce(p{j}, -1)" for j in range(1, i)) + f") and not {_TOC.replace('title', f't{i}')} then t{i} end" if i > 1 else f"case when p1 is not null and not {_TOC.replace('title', 't1')} then t1 end" for i in range(1, 7)) + "], lambda x: x is not null), ' > ') as path, page from h"
)


def blocks(spark, sf_dir):
    return structure.segments(lines(spark, sf_dir)).select("doc", F.col("segment").cast("long").alias("segment"), "kind", "first_pos", "n", F.md5("content").alias("content_md5"))


BLOCKS_SQL = rf"""
with l as (select *, case when starts_with({_S}, '|') and ends_with({_S}, '|') then 'table' else 'text' end as kind from ({MARKDOWN})),
c as (select *, coalesce(cast(kind <> lag(kind) over (partition by doc order by pos) as int), 0) as ch from l), s as (select *, sum(ch){B} as segment from c)
select doc, cast(segment as bigint) as segment, kind, min(pos) as first_pos, count(*) as n, md5(regexp_replace(string_agg(line, chr(10) order by pos), '^\s+|\s+$', '', 'g')) as content_md5 from s group by doc, segment, kind
"""


def clauses(spark, sf_dir):
    return structure.clauses(lines(spark, sf_dir)).select("doc", F.col("run").cast("long").alias("run"), "jo", "title", "first_pos", "end_pos", F.md5("body").alias("body_md5"))


_M = rf"regexp_replace(line, '{structure.OTHER_LAW}', '', 'g')"
_C = structure.CLAUSE.replace("'", "''")
_CLAUSES = rf"""
l as (select doc, pos, line, {_M} as m from ({MARKDOWN})),
f as (select doc, pos, cast(regexp_extract(m, '{_C}', 1) as int) as jo, coalesce(nullif(regexp_extract(m, '{_C}', 2), ''), regexp_extract(m, '{_C}', 3)) as t from l where regexp_matches(m, '{_C}') and not regexp_matches(m, '{structure.LEADERS}')),
t as (select doc, pos, jo, case when length(t) % 2 = 1 and substr(t, length(t) // 2 + 1, 1) = ' ' and substr(t, 1, length(t) // 2) = substr(t, length(t) // 2 + 2) then substr(t, 1, length(t) // 2) else t end as title, coalesce(cast(jo <= lag(jo) over (partition by doc order by pos) as int), 0) as again, lead(pos) over (partition by doc order by pos) as nxt from f),
r as (select *, sum(again){B} as run from t),
b as (select r.doc, r.pos, regexp_replace(string_agg(l.line, chr(10) order by l.pos), '^\s+|\s+$', '', 'g') as body from r join l on r.doc = l.doc and l.pos >= r.pos and l.pos < coalesce(r.nxt, 1000) group by 1, 2)
"""
CLAUSES_SQL = f"with {_CLAUSES} select r.doc, cast(run as bigint) as run, jo, title, r.pos as first_pos, nxt - 1 as end_pos, md5(body) as body_md5 from r join b using (doc, pos)"


def integrity(spark, sf_dir):
    return structure.clause_integrity(structure.clauses(lines(spark, sf_dir))).select("doc", F.col("run").cast("long").alias("run"), "n", "structure")


INTEGRITY_SQL = f"""with {_CLAUSES}, g as (select doc, run, list(jo) as a, count(*) as n, max(cast(title = '' as int)) as blank from r group by doc, run)
select doc, cast(run as bigint) as run, n, coalesce(nullif(concat_ws(',', case when len(list_filter(range(1, list_max(a) + 1), lambda x: not list_contains(a, x))) > 0 then 'gap' end, case when len(list_distinct(a)) < len(a) then 'dup' end, case when blank = 1 then 'blank' end), ''), 'clean') as structure from g"""


def refs(spark, sf_dir):
    return structure.clause_refs(structure.clauses(lines(spark, sf_dir))).select("doc", F.col("run").cast("long").alias("run"), "jo", "ref_type", "target", "resolved")


REFS_SQL = rf"""with {_CLAUSES}, m as (select r.doc, r.run, r.jo, regexp_replace(body, '{structure.OTHER_LAW}', '', 'g') as x from r join b using (doc, pos)),
e as (select distinct doc, run, jo, '조항' as ref_type, cast(unnest(regexp_extract_all(x, '제\s*(\d+)\s*조', 1)) as int) as target from m union select distinct doc, run, jo, '별표', cast(unnest(regexp_extract_all(x, '별표\s*(\d+)', 1)) as int) from m)
select doc, cast(run as bigint) as run, jo, ref_type, target, ref_type = '조항' and exists (select 1 from r where r.doc = e.doc and r.run = e.run and r.jo = e.target) as resolved from e where ref_type <> '조항' or target <> jo"""


def annexes(spark, sf_dir):
    return structure.annex_rows(lines(spark, sf_dir)).select("doc", "no", "pos", "section", F.array_join("codes", ",").alias("codes"))


ANNEXES_SQL = rf"""
with l as (select *, last_value(case when regexp_matches(line, '{structure.ANNEX}') and not regexp_matches(line, '{structure.LEADERS}') then cast(regexp_extract(line, '{structure.ANNEX}', 1) as int) end ignore nulls){B} as no,
  last_value(case when contains(line, '보장대상이 되는') then '보장' when contains(line, '지급하지 않는') or contains(line, '제외하여') then '미보장' end ignore nulls){B} as section, list_transform(regexp_extract_all(line, '{structure.ICD}'), lambda c: replace(c, ' ', '')) as c from ({MARKDOWN}))
select doc, no, pos, section, array_to_string(c, ',') as codes from l where no is not null and len(c) > 0
"""


def payout_rows(spark, sf_dir):
    return structure.payout_rows(lines(spark, sf_dir)).withColumn("rate_pct", F.col("rate_pct").cast("double"))


PAYOUT_ROWS_SQL = rf"select doc, pos, '12개월 급여' as coverage, cast(1.5 as double) as rate_pct, '매월' as per_unit, cast(regexp_extract(line, '([0-9]+)\s*일\s*한도', 1) as int) as limit_days, 50 as reduction_rate_pct, '1년이내' as reduction_period, '재해외' as reduction_cause from ({MARKDOWN}) where starts_with(line, '| 12개월')"


def matrix(spark, sf_dir):
    return structure.payout_matrix(lines(spark, sf_dir))


MATRIX_SQL = rf"""
with c as (select doc, pos, unnest(['90일이하', '90일초과1년미만', '1년이상']) as b, unnest([split_part(line, '|', 3), split_part(line, '|', 4), split_part(line, '|', 5)]) as v from ({MARKDOWN}) where starts_with(line, '| 레진')),
f as (select *, cast(regexp_extract(v, '([0-9]+)\s*%', 1) as int) as rate, count(*) over (partition by doc) as n from c where regexp_matches(v, '가입금액의?\s*[0-9]+\s*%'))
select doc, pos, '레진' as coverage, cast(null as varchar) as cause, case when n > 1 then b end as period_bucket, rate as rate_pct from f
"""


def terms(spark, sf_dir):
    docs = lines(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))
    return structure.contract_terms(docs)


TERMS_SQL = rf"""
with d as (select doc, string_agg(line, chr(10) order by pos) as text from ({MARKDOWN}) group by doc)
select doc, coalesce(try_cast(nullif(regexp_extract(text, '철회[^\n]{{0,50}}?(\d+)\s*일\s*이내', 1), '') as int), try_cast(nullif(regexp_extract(text, '(\d+)\s*일\s*이내[^\n]{{0,30}}?철회', 1), '') as int)) as cooling_off_days, regexp_matches(text, '갱신\s*형|자동\s*갱신|\d+\s*년\s*마다\s*갱신') as is_renewable,
  try_cast(nullif(regexp_extract(text, '(\d+)\s*년\s*마다\s*갱신', 1), '') as int) as renewal_cycle_years, try_cast(nullif(regexp_extract(text, '(\d+)\s*년\s*만기', 1), '') as int) as term_years from d
"""


def layout(spark, sf_dir):
    return structure.reading_order(frame(spark, sf_dir, NODES)).select("doc", "page", "id", F.col("column").cast("long").alias("col"), "place")


LAYOUT_SQL = f"""
with g as (select *, coalesce(cast(x0 - lag(x0) over w > 60 as int), 0) as gap from ({NODES}) window w as (partition by doc, page order by x0, id)),
c as (select *, sum(gap) over (partition by doc, page order by x0, id rows between unbounded preceding and current row) as col from g)
select doc, page, id, cast(col as bigint) as col, cast(row_number() over (partition by doc order by page, col, y1 desc, id) as int) as place from c
"""


def asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.filter("event_type <> 'purchase'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.col("event_id").alias("at"))
    marks = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("at"), "value")
    return structure.nearest_before(points, marks).select("doc", "id", "value")


def merged(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("seq"), F.col("l_returnflag").alias("heading_path"), F.col("l_linenumber").alias("start_page")).groupBy("doc", "seq", "start_page").agg(F.min("heading_path").alias("heading_path"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1000).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("A")).alias("heading_path"), F.lit(3).alias("start_page"))
    return structure.merge_recognised(chunks, seen)


MERGED_SQL = """
with c as (select l_orderkey as doc, l_linenumber * 10 as seq, min(l_returnflag) as h, l_linenumber as page from lineitem group by l_orderkey, l_linenumber), e as (select doc, max(seq) as e from c group by 1),
r as (select o_orderkey as doc, e, case when o_orderkey % 2 = 0 then coalesce((select max(seq) from c where c.doc = o_orderkey and h = 'A'), e) + 0.5 else coalesce((select min(seq) from c where c.doc = o_orderkey and page > 3) - 0.5, e + 0.5) end as at_ from orders join e on e.doc = o_orderkey),
u as (select doc, seq, false as recognised, cast(seq as double) as at_ from c union all select doc, 1000, true, at_ from r)
select doc, cast(seq as int) as seq, recognised, cast(row_number() over (partition by doc order by at_, recognised, seq) as int) as new_seq from u
"""


def fixed(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")).select("doc", "part", "first", "end", F.md5("content").alias("content_md5"))



#: Windows one after the other: each ends behind the last blank, line or sentence end in its second half, and the next begins 150 before.
FIXED_SQL = r"""
with recursive t as (select doc_id as doc, text, length(text) as n from documents where length(text) > 0),
w as (select doc, text, n, 0 as at_, case when n <= 800 then n when length(regexp_extract(substr(text, 1, 800), '(?s)^(.*[\n .])', 1)) > 401 then length(regexp_extract(substr(text, 1, 800), '(?s)^(.*[\n .])', 1)) else 800 end as e from t
 union all select doc, text, n, a, case when a + 800 < n and length(regexp_extract(substr(text, a + 1, 800), '(?s)^(.*[\n .])', 1)) > 401 then a + length(regexp_extract(substr(text, a + 1, 800), '(?s)^(.*[\n .])', 1)) else a + 800 end
 from (select *, at_ + case when e - at_ > 150 then e - at_ - 150 else 400 end as a from w where n > 800) where a < n),
p as (select doc, at_, e, case when n <= 800 then text else regexp_replace(substr(text, at_ + 1, e - at_), '^\s+|\s+$', '', 'g') end as c from w)
select doc, cast(row_number() over (partition by doc order by at_) as int) as part, cast(at_ as int) as first, cast(e as int) as end, md5(c) as content_md5 from p where c <> ''
"""



def adaptive(spark, sf_dir):
    """Chunks of the contracts, whose orders are dealt out before they become lines: these are sixteen times as many, and stay where they are."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // ORDERS_A_TASK))
    dealt = spark.sql(MARKDOWN.replace("from orders", "from {orders}"), orders=orders.repartition(tasks, "o_orderkey"))
    return chunking.adaptive_chunks(dealt)


def tree_chunks(spark, sf_dir):
    """Chunks of markdown made from documents: every seventh sentence is a heading, every eleventh is followed by a page mark."""
    marked = F.transform(F.split("text", r"\. "), lambda s, i: F.when(i % 7 == 3, F.concat(F.repeat(F.lit("#"), (i % 5 + 1).cast("int")), F.lit(" "), s)).when(i % 11 == 5, F.concat(s, F.lit(".\n<!-- page:"), (i / 11).cast("int").cast("string"), F.lit(" -->"))).otherwise(F.concat(s, F.lit("."))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array_join(marked, "\n").alias("text"))
    return chunking.chunk_markdown(docs).select("doc", "node", "part", "heading", "path", "kind", "part_index", "part_total", "first_page", "last_page", F.md5("content").alias("content_md5"))


QUERIES = {
    "w12_heading_paths": (paths, PATHS_SQL),
    "w14_segments": (blocks, BLOCKS_SQL),
    "d10_clauses": (clauses, CLAUSES_SQL),
    "ag30_clause_integrity": (integrity, INTEGRITY_SQL),
    "d14_clause_refs": (refs, REFS_SQL),
    "d25_annex_rows": (annexes, ANNEXES_SQL),
    "d19_payout_rows": (payout_rows, PAYOUT_ROWS_SQL),
    "d20_payout_matrix": (matrix, MATRIX_SQL),
    "d18_contract_terms": (terms, TERMS_SQL),
    "w16_reading_order": (layout, LAYOUT_SQL),
    "j12_nearest_before": (asof, "select p.user_id as doc, p.event_id as id, m.value from (select * from events where event_type <> 'purchase') p asof left join (select * from events where event_type = 'purchase') m on p.user_id = m.user_id and p.event_id >= m.event_id"),
    "j14_merge_recognised": (merged, MERGED_SQL),
    "d5_fixed_chunks": (fixed, FIXED_SQL),
    "d1_adaptive_chunks": (adaptive, None),
    "d1_tree_chunks": (tree_chunks, None),
}
