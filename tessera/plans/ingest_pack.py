"""Queries of ingestion over contracts in markdown made from orders, and of recognised images made from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ingest, quality, recognition, structure
from tessera.plans.base import frame, table
from tessera.plans.structure_pack import _CLAUSES, MARKDOWN, lines
from tessera.plans.text_pack import q

C = "cast({} as string)"
#: Twelve lines for each order, of contracts with riders, contents and annexes, that vary with its columns.
CONTRACT = f"""
select o_orderkey as doc, v.pos as pos, case v.pos
  when 1 then case o_orderkey % 4 when 0 then '## 목 차' when 1 then concat('# 무배당 ', {C.format('o_custkey')}보험') else concat('### ', {C.format('o_custkey % 9')}, '. 수술비(간편)') end
  when 2 then case when o_custkey % 3 = 0 then '### 제1절 안내' else 'KB손보 회사미상 갱신형' end
  when 3 then case o_custkey % 3 when 0 then concat('#', repeat('#', cast(o_orderkey % 3 as int)), ' 보통약관') else '본문입니다.' end
  when 4 then case when o_orderkey % 6 > 0 then '제1조(목적) 이 약관은 ﻿내용을 정합니다.   ' else '- 제2조【용어의 정의】' end
  when 5 then concat('회사는 피보험자가 ', {C.format('o_custkey')}, '일 입원한 경우에는 보험수익자에게 입원급여금 (별표 ', {C.format('o_custkey % 4')}, ') 을 드립니다. 제1조')
  when 6 then case o_orderkey % 5 when 0 then '제3조(보험금의 지급사유)' when 1 then '제2조(지급사유)' when 2 then '제2조【보험금을 지급하지 않는 사유】' else '① 첫째 항' end
  when 7 then case o_custkey % 4 when 0 then '의료법 시행규칙 별표 4' when 1 then '1. 고의로 지급하지 않는 경우' when 2 then '보험수익자에게 암진단자금 (별표 2)' else '1. 첫째 호' end
  when 8 then case when o_custkey % 2 = 0 then '## 수술 특별약관' else '가. 첫째 목' end
  when 9 then case when o_custkey % 2 = 0 then '제1조(준용) 제9조와 별표 3 참조' else '제4조(준용규정) 보통약관 제2조' end
  when 10 then case when o_orderkey % 3 = 0 then '제2조(면책) 지급하지 않는 것' else '2. 둘째 호 ............ 5' end
  when 11 then concat('(별표', {C.format('o_custkey % 3 + 1')}, ') ', case o_orderkey % 3 when 0 then '악성신생물 분류표' when 1 then '적립이율 계산' else '지급기준표 지급기준표' end)
  else case when o_orderkey % 7 = 0 then '(별표2) 지급기준표' else concat('![image 1](a/', {C.format('o_custkey')}, '.png) C50') end end as line
from orders cross join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) as v(pos)
""".replace("보험')", "'보험')").replace(f"{C.format('o_custkey')}'보험')", f"{C.format('o_custkey')}, '보험')")
B = " over (partition by doc order by pos rows between unbounded preceding and current row)"
_S = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_M = rf"regexp_replace(line, {q(structure.OTHER_LAW)}, '', 'g')"
#: The clauses of CONTRACT, as rows of starts r and bodies b.
PARSED = rf"""
l as (select doc, pos, line, {_M} as m from ({CONTRACT})),
s as (select doc, pos, cast(regexp_extract(m, {q(structure.CLAUSE)}, 1) as int) as jo, coalesce(nullif(regexp_extract(m, {q(structure.CLAUSE)}, 2), ''), regexp_extract(m, {q(structure.CLAUSE)}, 3)) as title from l where regexp_matches(m, {q(structure.CLAUSE)}) and not regexp_matches(m, {q(structure.LEADERS)})),
r as (select *, sum(again){B} as run from (select *, coalesce(cast(jo <= lag(jo) over (partition by doc order by pos) as int), 0) as again from s)),
o as (select l.*, max(s.pos) over (partition by l.doc order by l.pos rows between unbounded preceding and current row) as owner from l left join s on l.doc = s.doc and l.pos = s.pos),
b as (select doc, owner as pos, regexp_replace(string_agg(line, chr(10) order by pos), '^\s+|\s+$', '', 'g') as body from o where owner is not null group by 1, 2),
p as (select r.doc, cast(run as bigint) as run, jo, title, r.pos as first_pos, body from r join b on r.doc = b.doc and r.pos = b.pos),
d as (select doc, string_agg(line, chr(10) order by pos) as text from l group by 1)
"""
ANNEXES = rf"""
ah as (select doc, pos, cast(regexp_extract(line, {q(structure.ANNEX)}, 1) as int) as no, trim(regexp_replace(regexp_extract(line, {q(structure.ANNEX)}, 2), '\s+', ' ', 'g')) as t from l where regexp_matches(line, {q(structure.ANNEX)}) and not regexp_matches(line, {q(structure.LEADERS)})),
ax as (select doc, no, case when length(t) % 2 = 1 and substr(t, length(t) // 2 + 1, 1) = ' ' and substr(t, 1, length(t) // 2) = substr(t, length(t) // 2 + 2) then substr(t, 1, length(t) // 2) else t end as title, pos as first_pos, lead(pos) over (partition by doc order by pos) as next from ah),
ab as (select ax.doc, ax.first_pos, regexp_replace(string_agg(line, chr(10) order by l.pos), '^\s+|\s+$', '', 'g') as body from ax join l on l.doc = ax.doc and l.pos >= ax.first_pos and (next is null or l.pos < next) group by 1, 2),
a as (select ax.doc, no, title, case when contains(title, '분류표') then 'classification' when contains(title, '이율') or contains(title, '계산') then 'formula' else 'payout' end as kind, ax.first_pos, next - 1 as end_pos, body from ax join ab on ab.doc = ax.doc and ab.first_pos = ax.first_pos qualify row_number() over (partition by ax.doc, no order by ax.first_pos) = 1)
"""


def contract(spark, sf_dir):
    return frame(spark, sf_dir, CONTRACT)


def parsed(spark, sf_dir):
    return structure.clauses(contract(spark, sf_dir))


def repaired(spark, sf_dir):
    return contract(spark, sf_dir).select("doc", "pos", F.array_join(text.repaired_line(F.col("line")), "\n").alias("lines"))


_I = r"regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?i)<br\s*/?>', ' ', 'g')"
_ART = r"^\s*[-*]?\s*(제\s*\d+\s*조(?:\s*의\s*\d+)?\s*(?:【[^】]*】|\([^)]*\)))(?:\s+(.*))?$"
_ARTB = r"^\s*[-*]?\s*(제\s*\d+\s*조(?:\s*의\s*\d+)?\s*【[^】]*】)\s*(.*)$"
REPAIRED_SQL = rf"""
with i as (select doc, pos, {_I} as line from ({CONTRACT})), j as (select *, trim(line) as s, trim(regexp_extract(trim(line), '^#{{1,6}}\s+(.*)$', 1)) as t from i),
k as (select *, case when regexp_matches(s, {q(_ARTB)}) then {q(_ARTB)} else {q(_ART)} end as art from j)
select doc, pos, case when regexp_matches(s, '\.{{4,}}|·{{5,}}|…{{3,}}') then '' when regexp_matches(s, '^#{{1,6}}\s+') then case when regexp_matches(t, {q(quality.FRAGMENT_TAIL)}) and not regexp_matches(t, {q(quality.STRUCTURE_MARK)}) then t else line end
  when regexp_matches(s, {q(_ARTB)}) then '##### ' || trim(regexp_extract(s, {q(_ARTB)}, 1)) || coalesce(chr(10) || nullif(trim(regexp_extract(s, {q(_ARTB)}, 2)), ''), '')
  when regexp_matches(s, {q(_ART)}) then '##### ' || trim(regexp_extract(s, {q(_ART)}, 1)) || coalesce(chr(10) || nullif(trim(regexp_extract(s, {q(_ART)}, 2)), ''), '') else line end as lines from k
"""


def contents(spark, sf_dir):
    return ingest.without_contents(contract(spark, sf_dir)).select("doc", "pos")


CONTENTS_SQL = rf"""
with h as (select doc, pos, length(regexp_extract({_S}, '^(#{{1,6}})\s+.+$', 1)) as level, regexp_matches({_S}, '^#{{1,6}}\s+(목\s*차|차\s*례)$') as toc from ({CONTRACT})),
t as (select doc, pos as a, level from h where toc), e as (select t.doc, a, min(h.pos) as z from t left join h on h.doc = t.doc and h.pos > a and h.level between 1 and t.level and not h.toc group by 1, 2)
select doc, pos from h where not exists (select 1 from e where e.doc = h.doc and h.pos >= a and (z is null or h.pos < z))
"""


def first(spark, sf_dir):
    return ingest.first_contract(parsed(spark, sf_dir)).select("doc", "jo", "title")


def annex(spark, sf_dir):
    return ingest.annexes(contract(spark, sf_dir)).withColumn("body", F.md5("body"))


def contracts(spark, sf_dir):
    own = contract(spark, sf_dir)
    return ingest.contracts(own, structure.clauses(own)).withColumn("run", F.col("run").cast("long"))


_CL = r"regexp_replace(line, '^[ #\-•*\t]+|[ #\-•*\t]+$', '', 'g')"
RUNS = rf"""
ru as (select doc, run, arg_min(jo, first_pos) as first_jo, arg_max(jo, first_pos) as last_jo, count(*) as n, min(first_pos) as first_pos from p group by 1, 2),
ow as (select doc, pos, sum(length(line) + 1){B} as e, case when starts_with({_S}, '#') and regexp_matches(line, '특별약관|보통약관') then {_CL} end as head, case when contains(line, '특별약관') or starts_with({_CL}, '보통약관') then {_CL} end as plain from l),
ne as (select ru.doc, ru.run, arg_max(x.head, x.pos) filter (x.head is not null) as head, arg_max(x.plain, x.pos) filter (x.plain is not null) as plain from ru join ow f on f.doc = ru.doc and f.pos = ru.first_pos join l fl on fl.doc = f.doc and fl.pos = f.pos join ow x on x.doc = ru.doc and x.pos < ru.first_pos and x.e > f.e - length(fl.line) - 1 - 400 group by 1, 2),
rn as (select ru.*, coalesce(head, plain, '') as heading from ru left join ne on ne.doc = ru.doc and ne.run = ru.run)
"""


def sections(spark, sf_dir):
    own = contract(spark, sf_dir)
    return ingest.load_sections(own, structure.clauses(own))


SECTIONS_SQL = rf"with {PARSED}, {RUNS} select doc, case when run > 0 then heading end as name, run > 0 as child, first_pos from rn where run = 0 or ends_with(heading, '특별약관')"


def riders(spark, sf_dir):
    own = contract(spark, sf_dir)
    return ingest.titled_contracts(own, structure.clauses(own))


RIDERS_SQL = rf"""
with {PARSED}, t as (select doc, pos, regexp_replace({_S}, '^[# ]+|[# ]+$', '', 'g') as name from l where starts_with({_S}, '#')),
n as (select * from t where not contains(name, '정하지') and not regexp_matches(name, '^제\s*\d+\s*조') and not regexp_matches(name, '용어|풀이|경우|명령|소비자|지났을|무효|금지|처리|제한|해당하는|예금자|가이드|목\s*차|요약|보호제도') and regexp_matches(name, '^\d+(-\d+)?\.\s{{0,2}}\S{{2,}}')),
j as (select p.doc, p.title, max(n.pos) as first_pos from p join n on n.doc = p.doc and n.pos <= p.first_pos group by p.doc, p.first_pos, p.title)
select j.doc, n.name, j.first_pos, count(*) as n from j join n on n.doc = j.doc and n.pos = j.first_pos group by 1, 2, 3 having count(*) >= 2 and bool_or(contains(j.title, '준용'))
"""


def products(spark, sf_dir):
    own = contract(spark, sf_dir)
    return ingest.products(ingest.joined(own), structure.clauses(own))


_COMPANY = "case " + " ".join(f"when contains(text, '{s}') then '{f}'" for s, f in sorted(ingest.COMPANIES, key=lambda c: -len(c[0]))) + " end"
PRODUCT = rf"""
gr as (select doc, arg_min(body, run * 1000 + jo) as g from p where contains(title, '지급사유') group by 1), df as (select doc, arg_min(jo, run * 1000 + jo) as jo from p where contains(title, '준용') group by 1),
pn as (select doc, list_filter(regexp_extract_all(text, '(?m)^#{{1,6}}\s*(.+?(?:특약|보험)[^\n#]*)$', 1), lambda t: not regexp_matches(t, '목차|안내|요약|유의사항|해설')) as names from d),
pr as (select d.doc, trim(names[1]) as name, {_COMPANY} as company, contains(text, '갱신형') or contains(text, '특약의 갱신') as is_renewable, trim(nullif(regexp_extract(g, '보험수익자에게\s*([^(（]+?)\s*[(（]\s*별표', 1), '')) as coverage_name,
  substr(regexp_replace(trim(nullif(regexp_extract(g, '회사는\s*(.+?)(?:때에는|경우에는)', 1), '')), '\s+', ' ', 'g'), 1, 150) as payout_condition, try_cast(nullif(regexp_extract(g, '별표\s*(\d+)', 1), '') as int) as payout_annex,
  '청약철회·대기기간 등 미기재 필드는 주계약 준용(제' || df.jo || '조) 소관. 주계약 문서 미확보 → 해당 질의는 ''답변 불가''가 정답.' as resolution_note
  from d join pn on pn.doc = d.doc left join gr on gr.doc = d.doc left join df on df.doc = d.doc)
"""


def subitems(spark, sf_dir):
    return ingest.with_subitems(parsed(spark, sf_dir)).select("doc", F.col("run").cast("long").alias("run"), "jo", "n_hang", "n_ho", "n_mok")


#: Counts of marks that come in their turn, for bodies of at most one paragraph, two items and one sub-item, as CONTRACT makes them.
SUBITEMS_SQL = rf"""
with {PARSED}, x as (select p.doc, run, jo, l.pos, trim(l.line) as s from p join o on o.doc = p.doc and o.owner = p.first_pos join l on l.doc = o.doc and l.pos = o.pos),
m as (select *, regexp_matches(s, '^① ') as h, try_cast(regexp_extract(s, '^(\d{{1,2}})\.\s', 1) as int) as ho, regexp_matches(s, '^가\. ') as k from x),
c as (select doc, run, jo, count(*) filter (h) as n_hang, count(*) filter (ho = 1) as one, min(pos) filter (ho = 1) as at1, max(pos) filter (ho = 2) as at2, count(*) filter (k) as k, min(pos) filter (k) as atk, min(pos) filter (h) as ath from m group by all)
select doc, run, jo, cast(n_hang as int) as n_hang, cast(one + coalesce(cast(one = 1 and at2 > at1 as int), 0) as int) as n_ho, cast(case when k = 1 and (ath < atk or at1 < atk) then 1 else 0 end as int) as n_mok from c
"""


def gate(spark, sf_dir):
    own = contract(spark, sf_dir)
    return quality.document_gate(ingest.joined(own), structure.clauses(own), ingest.annexes(own))


GATE_SQL = rf"""
with {PARSED}, {ANNEXES},
c as (select doc, count(distinct run) as runs, count(*) filter (run = 0) as n, max(jo) filter (run = 0) as last, bool_or(trim(body) = '') filter (run = 0) as blank, bool_or(length(body) > 1600) filter (run = 0) as long from p group by 1),
f as (select doc, unnest(regexp_extract_all(text, '(?s)(.{{0,20}})별\s*표\s*(\d+)', 1)) as b, unnest(regexp_extract_all(text, '(?s)(.{{0,20}})별\s*표\s*(\d+)', 2)) as no from d),
u as (select distinct f.doc from f left join a on a.doc = f.doc and a.no = cast(f.no as int) where not regexp_matches(b, '[」』]|시행규칙|시행령|법\s*$|규칙') and a.doc is null),
e as (select d.doc, len(regexp_extract_all(text, '[가-힣]')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1) >= 0.3 as hangul, coalesce(runs, 0) as runs, coalesce(n, 0) as n, coalesce(last, 0) as last, coalesce(blank, false) as blank, coalesce(long, false) as long, u.doc is not null as open from d left join c on c.doc = d.doc left join u on u.doc = d.doc)
select doc, 'hangul' as check, case when hangul then 'PASS' else 'FAIL' end as verdict from e union all select doc, 'compound', 'WARN' from e where runs >= 2 union all select doc, 'in_order', case when last = n then 'PASS' else 'FAIL' end from e where runs < 2
union all select doc, 'clauses', case when n between 5 and 60 then 'PASS' else 'FAIL' end from e where runs < 2 union all select doc, 'blank', case when blank then 'WARN' else 'PASS' end from e union all select doc, 'length', case when long then 'WARN' else 'PASS' end from e union all select doc, 'annexes', case when open then 'WARN' else 'PASS' end from e
"""


def _grounded(spark, sf_dir):
    own = contract(spark, sf_dir)
    rows = structure.clauses(own)
    return quality.grounding(ingest.products(ingest.joined(own), rows), rows, ingest.annexes(own))


GROUNDED = rf"""
gd as (select pr.doc, 'coverage_name' as check, case when coverage_name is null then 'NA' when contains(g, coverage_name) then 'PASS' else 'REJECT' end as verdict from pr left join gr on gr.doc = pr.doc
 union all select pr.doc, 'payout_annex', case when payout_annex is null then 'NA' when a.doc is not null then 'PASS' else 'REJECT' end from pr left join a on a.doc = pr.doc and a.no = payout_annex
 union all select doc, 'exclusion_' || run || '_' || jo, case when regexp_matches(body, '지급하지 않|지급하지아니|보상하지 않|보장하지 않') then 'PASS' else 'REJECT' end from p where regexp_matches(title, '지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책'))
"""


def rate(spark, sf_dir):
    return quality.resolution_rate(structure.clause_refs(parsed(spark, sf_dir)))


RATE_SQL = rf"""
with {PARSED}, x as (select distinct doc, run, jo, unnest(regexp_extract_all(regexp_replace(body, {q(structure.OTHER_LAW)}, '', 'g'), '제\s*(\d+)\s*조', 1)) as t from p),
y as (select x.doc, x.jo, exists (select 1 from p where p.doc = x.doc and p.run = x.run and p.jo = cast(t as int)) as ok from x where cast(t as int) <> x.jo)
select doc, count(*) as n, cast(count(*) filter (ok) as bigint) as resolved, round(count(*) filter (ok) / count(*), 6) as rate, count(*) filter (ok) / count(*) < 0.9 as low from y group by 1
"""


def missing(spark, sf_dir):
    own = contract(spark, sf_dir)
    return quality.annex_refs_open(ingest.joined(own), ingest.annexes(own)).select("doc", F.array_join("missing", ",").alias("missing"))


MISSING_SQL = rf"with {PARSED}, {ANNEXES}, f as (select distinct doc, cast(unnest(regexp_extract_all(text, '별\s*표\s*(\d+)', 1)) as int) as no from d), g as (select f.* from f left join a on a.doc = f.doc and a.no = f.no where a.doc is null) select d.doc, coalesce(string_agg(g.no, ',' order by g.no), '') as missing from d left join g on g.doc = d.doc group by 1"


def general(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return ingest.general_exclusions(structure.exclusion_map(rows), rows).withColumn("run", F.col("run").cast("long"))


def load_set(spark, sf_dir):
    own = contract(spark, sf_dir)
    rows = structure.clauses(own)
    product = ingest.products(ingest.joined(own), rows)
    return ingest.index_rows(rows, ingest.annexes(own), product.filter("name is not null")).withColumn("content", F.md5("content"))


def staged(spark, sf_dir):
    found = ingest.stage(ingest.joined(contract(spark, sf_dir)))
    n = found["clauses"].groupBy("doc").agg(F.count("*").alias("clauses"))
    return found["profile"].join(found["clean"].select("doc", F.md5("text").alias("clean_md5")), "doc").join(n, "doc", "left")


STAGED_SQL = rf"""
with {PARSED}, c as (select doc, regexp_replace(regexp_replace(replace(text, '﻿', ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as t from d), n as (select doc, count(*) as clauses from p where run = 0 group by 1),
k as (select doc, md5(t) as clean_md5, cast(len(regexp_extract_all(t, '제\s*\d+\s*조\s*【')) as bigint) as titles_full, cast(len(regexp_extract_all(t, '제\s*\d+\s*조\s*\(')) as bigint) as titles_half, len(regexp_extract_all(t, '특별약관')) > 5 as compound, cast(len(regexp_extract_all(t, '<!-- page:')) as bigint) as page_marks from c)
select k.*, case when titles_full >= titles_half then 'full' else 'half' end as format, clauses from k left join n on n.doc = k.doc
"""
BLOCKS = "select l_orderkey as doc, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey as image, case l_partkey % 6 when 0 then 'Header' when 1 then 'table ' when 2 then 'TABLEAU' when 3 then 'page_number' when 4 then 'title' else 'text' end as label, case l_suppkey % 3 when 0 then concat(' 본문 글자 number ', cast(l_partkey as string), ' ') when 1 then '' else concat('회사는 지급합니다 ', cast(l_suppkey as string)) end as text, case when l_suppkey % 2 = 0 then concat('<table><tr><th>구분</th><td>', cast(l_partkey as string), '<br/>x</td></tr><tr><td> a  b </td><td></td></tr></table>') end as html, l_discount * 10 as score from lineitem"


def responses(spark, sf_dir):
    rows = frame(spark, sf_dir, BLOCKS).withColumn("score", F.col("score").cast("double"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("image", "label", "text", "html", "score"))), lambda b: F.struct(b.label.alias("label"), b.text.alias("text"), b.html.alias("html"), b.score.alias("score")))
    own = rows.groupBy("doc").agg(recognition.response(recognition.confident(blocks)).alias("r"))
    return own.select("doc", "r.text", F.array_join("r.tables", "\n\n").alias("tables"), F.array_join("r.dropped", ",").alias("dropped"))


RESPONSES_SQL = f"""
with b as (select *, lower(trim(label)) as lab, trim(text) as t, '| 구분 | ' || regexp_extract(html, '<td>(\\d+)<br', 1) || ' x |' || chr(10) || '|---|---|' || chr(10) || '| a b |  |' as md from ({BLOCKS}) where cast(score as double) >= 0.5),
k as (select *, case when lab in ('header', 'page_number') then 'drop' when lab in ('table', 'tableau') then 'table' else 'text' end as kind, case when html is not null then md else t end as tab from b)
select d.doc, coalesce(string_agg(nullif(t, ''), chr(10) order by image) filter (kind = 'text'), '') as text, coalesce(string_agg(nullif(tab, ''), chr(10) || chr(10) order by image) filter (kind = 'table'), '') as tables, coalesce(string_agg(lab, ',' order by image) filter (kind = 'drop'), '') as dropped
from (select distinct doc from ({BLOCKS})) d left join k on k.doc = d.doc group by d.doc
"""


def tags(spark, sf_dir):
    return recognition.image_tags(contract(spark, sf_dir))


TAGS_SQL = rf"with h as (select *, last_value(nullif(regexp_extract({_S}, '^#{{1,6}}\s+(.+)$', 1), '') ignore nulls){B} as heading from ({CONTRACT})) select doc, pos, heading, cast(null as int) as page, 0 as n, regexp_extract(line, '!\[image\s+\d+\]\(([^)]+)\)', 1) as image from h where regexp_matches(line, '!\[image\s+\d+\]')"


def image_chunks(spark, sf_dir):
    found = tags(spark, sf_dir)
    words = F.when(F.col("doc") % 4 == 0, F.coalesce("heading", F.lit("짧다"))).when(F.col("doc") % 4 == 1, "짧다").otherwise(F.concat(F.lit("이 그림은 보험금 지급 절차를 보여 줍니다 "), F.col("doc").cast("string")))
    seen = found.select("doc", "image", words.alias("text"), F.array(F.lit("| a | b | c |"), F.lit("| a |")).alias("tables"))
    titles = contract(spark, sf_dir).select("doc", text.heading(F.col("line"))[1].alias("title")).filter("title is not null")
    return recognition.recognised_chunks(found, seen, titles).drop("page")


IMAGE_CHUNKS_SQL = f"""
with t as ({TAGS_SQL}), x as (select doc, pos, n, heading, '이 그림은 보험금 지급 절차를 보여 줍니다 ' || doc as c, doc % 4 >= 2 as k from t)
select doc, pos, n, heading, 0 as part, 'image' as chunk_type, c as content, cast(length(c) as int) as char_count from x where k union all select doc, pos, n, heading, cast(k as int), 'table', '| a | b | c |', 13 from x
"""


def rechunked(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 30).alias("doc"), F.array(F.lit("약관"), "o_orderstatus").alias("path"), F.col("o_orderdate").cast("string").alias("content"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"))
    new = recognition.text_chunk_rows(own, "adaptive")
    old = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 30).alias("doc"), F.col("l_linenumber").cast("long").alias("seq"), F.when(F.col("l_partkey") % 3 == 0, "image").when(F.col("l_partkey") % 3 == 1, "table").otherwise("text").alias("chunk_type"), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("x"))).alias("image_ocr_texts"))
    return recognition.keep_recognised(old, new).groupBy("doc", "chunk_type", "heading", "heading_path").agg(F.count("*").alias("n"), F.sum("part_index").alias("parts"), F.max("part_total").cast("long").alias("total"), F.sum("char_count").alias("chars"))


RECHUNKED_SQL = """
with n as (select o_custkey % 30 as doc, 'text' as chunk_type, o_orderstatus as heading, '약관 > ' || o_orderstatus as heading_path, row_number() over w as k, count(*) over (partition by o_custkey % 30, o_orderstatus) as t , length(cast(o_orderdate as varchar)) as c from orders window w as (partition by o_custkey % 30, o_orderstatus order by o_orderkey)),
o as (select l_orderkey % 30 as doc, case l_partkey % 3 when 0 then 'image' else 'table' end as chunk_type from lineitem where l_partkey % 3 < 2 and l_suppkey % 2 = 0)
select doc, chunk_type, heading, heading_path, count(*) as n, cast(sum(k) as bigint) as parts, max(t) as total, cast(sum(c) as bigint) as chars from n group by 1, 2, 3, 4 union all select doc, chunk_type, null, null, count(*), null, null, null from o group by 1, 2
"""


def spans(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    marks = F.filter(F.array(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")), F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 9).cast("int"))), lambda x: x.isNotNull())
    a, b = text.page_span(F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 7).cast("int")), marks)
    edges = recognition.box(F.col("l_quantity"), F.col("l_tax"), F.lit(None), F.lit(None), F.array(F.lit(9.0), F.lit(9.0), F.col("l_extendedprice").cast("double"), F.lit(0.0)))
    return l.groupBy(a.alias("first"), b.alias("last")).agg(F.count("*").alias("n"), F.round(F.sum(edges.x1 - edges.x0), 2).alias("width"))


SPANS_SQL = """
with m as (select case when l_partkey % 4 > 0 then cast(l_partkey % 7 as int) end as p, list_filter([case when l_linenumber % 2 = 0 then cast(l_linenumber as int) end, case when l_suppkey % 3 = 0 then cast(l_suppkey % 9 as int) end], lambda x: x is not null) as k, cast(l_quantity as double) as a, cast(l_extendedprice as double) as b from lineitem)
select least(p, list_min(k)) as first, coalesce(list_max(k), p) as last, count(*) as n, round(sum(greatest(a, b) - least(a, b)), 2) as width from m group by 1, 2
"""


def names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit("<br>(x "), "p_brand", F.lit(")  y ")).alias("n"))
    return p.select("p_partkey", text.clean_coverage(F.col("n")).alias("clean"), text.plain_coverage(F.col("n")).alias("plain"))


def offsets(spark, sf_dir):
    return ingest.offsets(contract(spark, sf_dir)).select("doc", "pos", "at")


def chunk_pages(spark, sf_dir):
    own = lines(spark, sf_dir)
    chunks = own.groupBy("doc", F.floor((F.col("pos") - 1) / 3).alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("content"))
    return ingest.chunk_pages(own, chunks)


CHUNK_PAGES_SQL = rf"""
with l as (select doc, pos, line, coalesce(sum(length(line) + 1) over (partition by doc order by pos rows between unbounded preceding and 1 preceding), 0) as a from ({MARKDOWN})),
m as (select doc, a, try_cast(nullif(regexp_extract(line, '^<!-- page:(\d+) -->', 1), '') as int) as page from l), r as (select doc, max(a + length(line)) as raw from l group by 1),
c as (select doc, (pos - 1) // 3 as seq, length(string_agg(line, chr(10) order by pos)) as n from l group by 1, 2), e as (select *, sum(n) over (partition by doc order by seq) as z, sum(n) over (partition by doc) as total from c),
p as (select e.doc, seq, floor(k / total * raw) as at_ from (select doc, seq, total, unnest([z - n, z]) as k from e) e join r on r.doc = e.doc),
f as (select p.doc, p.seq, p.at_, arg_max(page, m.a) as page from p left join m on m.doc = p.doc and page is not null and m.a <= p.at_ group by 1, 2, 3)
select doc, seq, min(page) as start_page, max(page) as end_page from f group by 1, 2
"""


def assembled(spark, sf_dir):
    from tessera.operators import service

    p = table(spark, sf_dir, "part")
    some = lambda n, c: F.when(F.col("p_partkey") % n > 0, c)
    reasons = F.when(F.col("p_partkey") % 5 > 1, F.array("p_brand", F.lit("고의"))).when(F.col("p_partkey") % 5 == 1, F.array().cast("array<string>"))
    return p.select("p_partkey", service.assemble(some(2, F.lit("보장")), some(3, F.col("p_type")), reasons, some(4, F.lit("확인")), some(2, F.col("p_brand")), some(6, F.lit("준용"))).alias("answer"))


ASSEMBLED_SQL = """
with a as (select p_partkey, concat_ws(chr(10), case when p_partkey % 2 > 0 then '• 보장: 보장' end, case when p_partkey % 3 > 0 then '• 지급: ' || p_type end, case when p_partkey % 5 > 1 then '• 면책 사유: ' || p_brand || ', 고의' end, case when p_partkey % 4 > 0 then '• 주의: 확인' end, case when p_partkey % 2 > 0 then '• ' || p_brand end, case when p_partkey % 6 > 0 then '• 준용' end) as answer from part)
select p_partkey, case when answer = '' then '관련 정보를 찾지 못했습니다(→RAG).' else answer end as answer from a
"""


def density(spark, sf_dir):
    return quality.density(parsed(spark, sf_dir), 60)


def titles(spark, sf_dir):
    return quality.titled_exclusions(parsed(spark, sf_dir), 1).select("doc", "jo", "title", "rank")


QUERIES = {
    "s5_repaired_lines": (repaired, REPAIRED_SQL),
    "w15_without_contents": (contents, CONTENTS_SQL),
    "w8_first_contract": (first, f"with {PARSED} select doc, jo, title from p where run = 0"),
    "w10_annexes": (annex, f"with {PARSED}, {ANNEXES} select doc, no, title, kind, first_pos, end_pos, md5(body) as body from a"),
    "w17_contracts": (contracts, f"with {PARSED}, {RUNS} select * from rn"),
    "d13_load_sections": (sections, SECTIONS_SQL),
    "d29_titled_contracts": (riders, RIDERS_SQL),
    "d17_products": (products, f"with {PARSED}, {PRODUCT} select *, case when coalesce(contains(name, '특약'), false) then '특약' else '주계약' end as kind from pr"),
    "ag31_subitem_counts": (subitems, SUBITEMS_SQL),
    "d26_document_gate": (gate, GATE_SQL),
    "d27_grounding": (_grounded, f"with {PARSED}, {ANNEXES}, {PRODUCT}, {GROUNDED} select * from gd"),
    "ag36_gate_totals": (lambda s, d: quality.gate_totals(_grounded(s, d)), f"with {PARSED}, {ANNEXES}, {PRODUCT}, {GROUNDED}, t as (select cast(count(*) filter (verdict = 'PASS') as bigint) as passed, cast(count(*) filter (verdict = 'REJECT') as bigint) as rejected from gd) select *, round(passed / (passed + rejected), 6) as precision from t"),
    "ag37_resolution_rate": (rate, RATE_SQL),
    "u8_missing_annexes": (missing, MISSING_SQL),
    "j2_general_exclusions": (general, f"with {PARSED} select distinct doc, run, jo, title from p where regexp_matches(title, '지급하지 않는|지급하지 아니|보상하지 않는|면책|부담보|보장하지 않는|지급하지않는')"),
    "j3_index_rows": (load_set, f"with {PARSED}, {ANNEXES}, {PRODUCT}, x as (select doc, 'clause' as kind, 'S' || run || '_제' || jo || '조' as ref, title, body from p union all select doc, 'annex', '별표' || no, title, body from a) select x.doc, pr.name as product_name, x.kind, x.ref, md5(case when coalesce(x.title, '') <> '' then x.title || chr(10) || chr(10) || x.body else x.body end) as content from x join pr on pr.doc = x.doc where pr.name is not null"),
    "sk14_staged": (staged, STAGED_SQL),
    "pf11_responses": (responses, RESPONSES_SQL),
    "j13_image_tags": (tags, TAGS_SQL),
    "d9_image_chunks": (image_chunks, IMAGE_CHUNKS_SQL),
    "d8_rechunked": (rechunked, RECHUNKED_SQL),
    "n3_page_spans": (spans, SPANS_SQL),
    "s15_coverage_names": (names, r"with n as (select p_partkey, ' ' || p_type || '<br>(x ' || p_brand || ')  y ' as n from part) select p_partkey, trim(regexp_replace(replace(n, '<br>', ' '), '\s+', ' ', 'g')) as clean, trim(regexp_replace(replace(regexp_replace(n, '\([^)]*\)', '', 'g'), '<br>', ' '), '\s+', ' ', 'g')) as plain from n"),
    "n4_offsets": (offsets, f"select doc, pos, cast(coalesce(sum(length(line) + 1) over (partition by doc order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as at from ({CONTRACT})"),
    "n13_density": (density, f"with {PARSED}, x as (select doc, count(distinct run) as contracts, count(*) as clauses, cast(sum(length(body)) as bigint) as chars from p group by 1) select *, round(chars / clauses, 6) as chars_each, chars / clauses > 60 as suspect from x"),
    "d4_chunk_pages": (chunk_pages, CHUNK_PAGES_SQL),
    "q13_assembled_answers": (assembled, ASSEMBLED_SQL),
    "n7_exclusion_titles": (titles, f"with {PARSED} select doc, jo, title, cast(1 as int) as rank from p where regexp_matches(title, '지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책') qualify row_number() over (partition by doc order by run, jo) = 1"),
}
