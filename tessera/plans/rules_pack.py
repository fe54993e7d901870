"""Queries of the rule tables over questions made from customers, and of code ranges over codes made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routing
from tessera.operators import rules
from tessera.plans.base import frame
from tessera.plans.text_pack import QUESTIONS, _first_sql, q

RULES = """select * from (values
 (1, '중환자실치료급여금', cast(null as string), cast(null as string), cast(null as string), 1, '1일당', 60, 0, cast(null as string), cast(null as string)),
 (2, '레진 충전', '질병', null, '90일이하', 0, null, null, null, null, null), (3, '레진 충전', '질병', null, '1년이상', 100, null, null, null, null, null), (4, '레진 충전', '질병', null, '90일초과1년미만', 50, null, null, 50, '1년이내', '재해외'), (5, '레진 충전', '상해', null, null, 100, '1회당', null, null, null, null),
 (6, '소득보장(12개월)', null, '15세미만', null, 30, '매월', null, null, null, null), (7, '소득보장(6개월)', null, '15세이상', null, 60, '매월', 0, 20, null, null), (8, '암진단자금', null, null, null, 100, null, null, 50, '1년이내', null), (9, '제자리암진단자금', null, null, null, 10, null, null, null, null, null))
 as r(ord, coverage, cause, age_band, period_bucket, rate_pct, per_unit, limit_days, reduction_rate_pct, reduction_period, reduction_cause)"""
PRODUCTS = """select * from (values ('P1', '치아보험', '레진 충전', cast(null as string), 15, true, 10, 20, cast(null as string)), ('P2', '중환자실 특약', '중환자실', null, null, false, null, null, '청약철회는 제 12 조 준용'), ('P3', '암보험', '제자리암', null, 30, cast(null as boolean), null, 5, '준용'), ('P4', '입원 특약', '입원', 'P1', 15, true, null, null, null))
 as p(product_id, product_name, coverage_name, parent_policy_id, cooling_off_days, is_renewable, renewal_cycle_years, term_years, resolution_note)"""
RANGES = """select * from (values (1, '암진단자금', 'C00~C14'), (2, '암진단자금', 'C15-C26.5'), (3, '암진단자금', 'C30~C97'), (4, '암진단자금', 'D45'), (5, '제자리암진단자금', 'D00~D09'), (6, '경계성종양진단자금', 'D37~D41.2'), (7, '경계성종양진단자금', 'D47.1')) as r(ord, coverage, code_token)"""
EXCLUSIONS = """select * from (values ('P1', 7, '보험금을 지급하지 않는 사유', '피보험자가 고의로 자신을 해친 경우, 임신, 출산'), ('P1', 9, '보장하지 않는 경우', '전쟁, 내란, 음주운전'), ('P3', 5, '지급하지 않는 사유', '특별한 사유')) as x(product_id, jo, title, body)"""
CODES = "select p_partkey as id, concat(case when p_partkey % 3 = 0 then 'D' else 'C' end, substr(cast(100 + p_partkey % 100 as string), 2, 2), case when p_partkey % 2 = 0 then concat('.', cast(p_partkey % 10 as string)) else '' end) as code, case p_partkey % 5 when 0 then '암진단자금' when 1 then '제자리암진단자금' when 2 then '경계성종양진단자금' end as coverage from part"

_ASK = f"""select id, question, {_first_sql([(w, w) for w in routing.PAYOUT_COVERAGES])} as ac, {_first_sql(routing.CAUSES, True)} as a1, {_first_sql(routing.AGES, True)} as a2, {_first_sql(routing.PERIODS, True)} as a3 from """
_PAY = f"""
c as (select a.*, r.*, max(cause is not null) over w as u1, max(age_band is not null) over w as u2, max(period_bucket is not null) over w as u3 from a join ({RULES}) r on contains(r.coverage, a.ac) window w as (partition by id)),
h as (select *, len(list_filter(regexp_split_to_array(coverage, '[\\s()/]+'), lambda t: length(t) >= 2 and contains(question, t))) as o from c where (a1 is null or not u1 or a1 is not distinct from cause) and (a2 is null or not u2 or a2 is not distinct from age_band) and (a3 is null or not u3 or a3 is not distinct from period_bucket)),
p as (select * from h qualify row_number() over (partition by id order by o desc, (period_bucket is null) desc, ord) = 1),
pay as (select id, ord, rate_pct, concat_ws(' ', coverage, '(' || age_band || ')', '[' || period_bucket || ']', '→ 가입금액의 ' || coalesce(per_unit || ' ', '') || rate_pct || '%', '(한도 ' || nullif(limit_days, 0) || '일)',
  '※' || case when concat_ws(' ', reduction_period, reduction_cause) <> '' then concat_ws(' ', reduction_period, reduction_cause) || ' 시' else '' end || ' ' || nullif(reduction_rate_pct, 0) || '% 감액') as answer from p)
"""
PAYOUT_SQL = f"with a as ({_ASK} ({QUESTIONS})), {_PAY} select id, ord, rate_pct, answer from pay"
_TERMS = """concat_ws(' · ', case when is_renewable then coalesce('갱신형(' || renewal_cycle_years || '년 주기)', '갱신형') when not is_renewable then '비갱신' end, term_years || '년 만기',
  coalesce('청약철회 ' || cooling_off_days || '일 이내', '청약철회: ' || coalesce(nullif(replace(regexp_extract(coalesce(resolution_note, ''), '제\\s*\\d+\\s*조'), ' ', ''), ''), '주계약') || ' 준용 소관 — 주계약 미확보로 확인 필요'))"""
_PRODUCT = f"select s.id, p.* from (select id, question, {_first_sql([(w, w) for w in routing.TERMS_COVERAGES])} as hint from ({{}})) s join ({PRODUCTS}) p on parent_policy_id is null and (contains(product_name, hint) or contains(coverage_name, hint)) qualify row_number() over (partition by s.id order by product_id) = 1"
_NUM = lambda x, m: f"(ascii({x}) * 1000 + cast(regexp_extract({x}, '^[A-Z](\\d+)', 1) as int) * 10 + coalesce(try_cast(nullif(regexp_extract({x}, '\\.(\\d)', 1), '') as int), {m}))"
_JUDGE = f"""
rg as (select *, {_NUM("regexp_split_to_array(code_token, '[~-]')[1]", 0)} as lo, {_NUM("regexp_split_to_array(code_token, '[~-]')[-1]", 9)} as hi from ({RANGES})),
m as (select k.id, k.code, k.coverage, min(case when rg.ord is not null and (k.coverage is null or rg.coverage = k.coverage) then row(rg.ord, rg.coverage, rg.code_token) end) as h, min(case when rg.coverage <> k.coverage then row(rg.ord, rg.coverage, rg.code_token) end) as t
  from k left join rg on {_NUM('k.code', 0)} between lo and hi group by 1, 2, 3),
j as (select id, code, case when h is not null then '보장' when t is not null then '미보장' else '판정불가' end as verdict, case when h is not null then h[2] else coverage end as coverage, case when h is null then t[2] end as redirect_coverage,
  case when h is not null then code || ' ∈ ' || h[2] || ' 범위 ' || h[3] when t is not null then code || '는 ' || t[2] || ' 범위(' || t[3] || ') — ' || coverage || ' 아님' else code || ' 어느 범위에도 없음 → RAG/전문가' end as evidence from m)
"""
_EXCLUSION_ONE = "list_filter([" + ", ".join("case when " + " or ".join(f"contains(coalesce(body, ''), {q(w)})" for w in ws) + f" then '{tag}' end" for tag, ws in routing.EXCLUSION_TAGS) + "], lambda t: t is not null)"


def _exclusions_sql(rows: str, notes: str) -> str:
    return f"""
xt as (select product_id, jo, list_sort({_EXCLUSION_ONE}) as tags from ({rows})),
xu as (select product_id, jo, unnest(tags) as tag, generate_subscripts(tags, 1) as i from xt),
xo as (select product_id, string_agg(tag, '·' order by jo, i) as tags from (select product_id, tag, min(jo) as jo, arg_min(i, jo) as i from xu group by 1, 2) group by 1),
xr as (select product_id, string_agg('제' || jo || '조', ' · ' order by jo) as refs from xt group by 1),
xa as (select p.product_id, coalesce(nullif(concat_ws('  ', case when xo.tags is not null then '지급 제외(면책) 사유: ' || xo.tags || ' 등 (' || xr.refs || ') — 상세는 해당 조 확인 필요' when xr.refs is not null then '지급 제외(면책): ' || xr.refs || ' 참조 — 확인 필요' end,
  case when contains(coalesce(resolution_note, ''), '준용') then '※ 공통면책(전쟁·임신·위험활동 등)은 ' || coalesce(nullif(replace(regexp_extract(resolution_note, '제\\s*\\d+\\s*조'), ' ', ''), ''), '주계약') || ' 준용 소관 — 주계약 미확보로 확인 필요' end), ''), '면책(지급 제외) 조를 찾지 못했습니다(→RAG).') as answer
  from ({notes}) p left join xr using (product_id) left join xo using (product_id))
"""


_EXCLUSIONS = _exclusions_sql(EXCLUSIONS, PRODUCTS)
#: Excluding clauses that suppliers stand for, by product for each nation, and what the products defer to.
CLAUSES_OF_NATIONS = """select concat('S', cast(s_nationkey as string)) as product_id, s_suppkey as jo, '지급하지 않는 사유' as title,
  case s_suppkey % 6 when 0 then '피보험자가 고의로 자신을 해친 경우, 임신, 출산' when 1 then '전쟁, 내란, 음주운전' when 2 then '특별한 사유' when 3 then '글라이더, 무면허 운전' when 4 then '출산 또는 혁명' end as body from supplier"""
NOTES_OF_NATIONS = "select concat('S', cast(n_nationkey as string)) as product_id, case n_nationkey % 4 when 0 then '청약철회는 제 12 조 준용' when 1 then '준용' when 2 then '없음' end as resolution_note from nation"
_GATED = lambda g: f"(select * from ({QUESTIONS}) where regexp_matches(question, {q(routing.GATES[g])}))"
CASCADE_SQL = f"""
with a as ({_ASK} {_GATED('payout')}), {_PAY},
te as (select id, {_TERMS} as answer from ({_PRODUCT.format(_GATED('terms')[1:-1])})),
k as (select id, coalesce(nullif(regexp_extract(question, '[A-Z]\\d{{2}}(?:\\.\\d)?'), ''), {_first_sql(routing.DISEASE_CODES)}) as code, {_first_sql(routing.COVERAGE_HINTS)} as coverage from {_GATED('coverage')} where coalesce(nullif(regexp_extract(question, '[A-Z]\\d{{2}}(?:\\.\\d)?'), ''), {_first_sql(routing.DISEASE_CODES)}) is not null),
{_JUDGE}, {_EXCLUSIONS},
ex as (select e.id, xa.answer from ({_PRODUCT.format(_GATED('exclusion')[1:-1])}) e join xa using (product_id))
select b.id, case when pay.answer is not null then 'payout' when te.answer is not null then 'terms' when j.id is not null then 'coverage' when ex.answer is not null then 'exclusion' else 'rag' end as kind,
  coalesce(pay.answer, te.answer, case when j.id is not null then concat_ws(' ', j.verdict, j.coverage, j.redirect_coverage, j.evidence) end, ex.answer) as answer
from ({QUESTIONS}) b left join pay on b.id = pay.id left join te on b.id = te.id left join j on b.id = j.id left join ex on b.id = ex.id
"""


def payout(spark, sf_dir):
    chosen = rules.select_payout(frame(spark, sf_dir, QUESTIONS), frame(spark, sf_dir, RULES))
    return chosen.select("id", "ord", "rate_pct", rules.format_payout().alias("answer"))


def terms(spark, sf_dir):
    return rules.resolve_product(frame(spark, sf_dir, QUESTIONS), frame(spark, sf_dir, PRODUCTS)).select("id", "product_id", rules.format_terms().alias("answer"))


def coverage(spark, sf_dir):
    return rules.judge_coverage(frame(spark, sf_dir, CODES), frame(spark, sf_dir, RANGES))


def reconciled(spark, sf_dir):
    out = rules.reconcile(coverage(spark, sf_dir), frame(spark, sf_dir, RULES))
    return out.select("id", "verdict", rules.effective_coverage().alias("pays"), "payout")


def exclusions(spark, sf_dir):
    return rules.format_exclusions(frame(spark, sf_dir, CLAUSES_OF_NATIONS), frame(spark, sf_dir, NOTES_OF_NATIONS))


def cascade(spark, sf_dir):
    return rules.cascade(*[frame(spark, sf_dir, s) for s in (QUESTIONS, RULES, PRODUCTS, RANGES, EXCLUSIONS)])


QUERIES = {
    "q3_payout": (payout, PAYOUT_SQL),
    "q7_terms": (terms, f"select id, product_id, {_TERMS} as answer from ({_PRODUCT.format(QUESTIONS)})"),
    "q10_coverage": (coverage, f"with k as ({CODES}), {_JUDGE} select * from j"),
    "q11_reconciled": (reconciled, f"""with k as ({CODES}), {_JUDGE}, b as (select id, verdict, case verdict when '보장' then coverage when '미보장' then redirect_coverage end as pays from j),
a as ({_ASK} (select id, pays || ' 얼마 지급' as question from b where pays is not null)), {_PAY} select b.id, b.verdict, b.pays, pay.answer as payout from b left join pay on b.id = pay.id"""),
    "q6_exclusions": (exclusions, f"with {_exclusions_sql(CLAUSES_OF_NATIONS, NOTES_OF_NATIONS).strip()} select * from xa"),
    "q12_cascade": (cascade, CASCADE_SQL),
}
