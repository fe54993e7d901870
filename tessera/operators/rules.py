"""Questions answered from rule tables: payout, contract terms, coverage of disease codes, exclusions, and the cascade over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import routing
from tessera.operators.barrier import once

AXES = ("cause", "age_band", "period_bucket")
NO_RULE = "관련 지급규칙을 찾지 못했습니다(→RAG)."
NO_TERMS = "관련 계약조건을 찾지 못했습니다(→RAG)."


def select_payout(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """The one rule for each question (id, question) that names a coverage.

    Candidates hold the coverage's name. An axis that the question gives filters only if some candidate uses
    it, which a window over the candidates tells. The most shared words win, then rules without a period, then
    the rules' order (ord).
    """
    asked = once(questions, {f"ask_{n}": c for n, c in routing.payout_intent(F.col("question")).items()}).filter(F.col("ask_coverage").isNotNull())
    names = rules.select("coverage").distinct().withColumn("key", F.explode(F.array_compact(F.array(*[F.when(F.col("coverage").contains(w), F.lit(w)) for w in routing.PAYOUT_COVERAGES]))))
    pairs = asked.join(names.join(rules, "coverage"), F.col("ask_coverage") == F.col("key"))
    mine = Window.partitionBy("id")
    pairs = pairs.withColumns({f"uses_{a}": F.max(F.col(a).isNotNull()).over(mine) for a in AXES})
    for a in AXES:
        pairs = pairs.filter(F.col(f"ask_{a}").isNull() | ~F.col(f"uses_{a}") | F.col(a).eqNullSafe(F.col(f"ask_{a}")))
    words = F.filter(F.split("coverage", r"[\s()/]+"), lambda w: F.length(w) >= 2)
    overlap = F.size(F.filter(words, lambda w: F.col("question").contains(w)))
    best = mine.orderBy(overlap.desc(), F.col("period_bucket").isNull().desc(), "ord")
    return pairs.withColumn("n", F.row_number().over(best)).filter("n = 1").select("id", "question", *rules.columns)


def format_payout() -> Column:
    """A rule as a line: what is null, and limits and reductions of 0, are left out; a rate of 0 stays."""
    positive = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    condition = F.concat_ws(" ", "reduction_period", "reduction_cause")
    cut = F.when(positive("reduction_rate_pct").isNotNull(), F.concat(F.lit("※"), F.when(condition != "", F.concat(condition, F.lit(" 시"))).otherwise(""), F.lit(" "), positive("reduction_rate_pct"), F.lit("% 감액")))
    rate = F.concat(F.lit("→ 가입금액의 "), F.when(F.col("per_unit").isNotNull(), F.concat("per_unit", F.lit(" "))).otherwise(""), F.col("rate_pct").cast("int").cast("string"), F.lit("%"))
    wrap = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b))
    return F.concat_ws(" ", "coverage", wrap("(", "age_band", ")"), wrap("[", "period_bucket", "]"), rate, F.concat(F.lit("(한도 "), positive("limit_days"), F.lit("일)")), cut)


def format_terms() -> Column:
    """Renewal, term and cooling-off of a product; without cooling-off days the clause that it defers to."""
    shown = lambda c, a, b: F.when(F.col(c) != 0, F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)))
    renewal = F.when(F.col("is_renewable"), F.coalesce(shown("renewal_cycle_years", "갱신형(", "년 주기)"), F.lit("갱신형"))).when(~F.col("is_renewable"), "비갱신")
    reference = F.coalesce(F.nullif(F.replace(F.regexp_extract(F.coalesce("resolution_note", F.lit("")), r"제\s*\d+\s*조", 0), F.lit(" "), F.lit("")), F.lit("")), F.lit("주계약"))
    cooling = F.coalesce(shown("cooling_off_days", "청약철회 ", "일 이내"), F.concat(F.lit("청약철회: "), reference, F.lit(" 준용 소관 — 주계약 미확보로 확인 필요")))
    return F.concat_ws(" · ", renewal, shown("term_years", "", "년 만기"), cooling)


def resolve_product(questions: DataFrame, products: DataFrame) -> DataFrame:
    """A base product for each question that names one of the known coverages; ties to the least id."""
    hinted = once(questions, {"hint": routing.keyword(F.col("question"), routing.TERMS_COVERAGES)}).filter(F.col("hint").isNotNull())
    keys = products.filter(F.col("parent_policy_id").isNull()).withColumn("key", F.explode(F.array_compact(F.array(*[F.when(F.col("product_name").contains(w) | F.col("coverage_name").contains(w), F.lit(w)) for w in routing.TERMS_COVERAGES]))))
    w = Window.partitionBy("id").orderBy("product_id")
    return hinted.join(keys, F.col("hint") == F.col("key")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "key", "hint")


def code_parts(code: Column, minor: Column | int = 0) -> Column:
    """A code as a number that orders as (letter, major, minor) does; null if it is none."""
    pattern = r"^\s*([A-Z])(\d{1,2})(?:\.(\d))?"
    digit = F.nullif(F.regexp_extract(code, pattern, 3), F.lit("")).cast("int")
    value = F.ascii(F.regexp_extract(code, pattern, 1)) * 1000 + F.regexp_extract(code, pattern, 2).try_cast("int") * 10 + F.coalesce(digit, minor if isinstance(minor, Column) else F.lit(minor))
    return F.when(code.rlike(pattern), value)


def range_bounds(tokens: DataFrame) -> DataFrame:
    """low and high of code_token: a range, one code, or a category for all its parts."""
    parts = F.split("code_token", r"\s*[~\-]\s*")
    last = F.element_at(parts, -1)
    return tokens.withColumns({"low": code_parts(F.get(parts, F.lit(0)), 0), "high": code_parts(last, 9)})


def judge_coverage(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """verdict, coverage, redirect_coverage, evidence for rows (id, code, coverage or null).

    Ranges are cut at the codes' categories, so a code meets the ranges of its category alone: an equi-join in
    place of a comparison of all with all. A code in the asked coverage is covered; in another, not, with a
    pointer to the first; in none, undecided. Without an asked coverage the first that has the code is it.
    """
    own = asked.withColumn("at", code_parts(F.col("code"), 0))
    cells = range_bounds(ranges).filter(F.col("low") <= F.col("high")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / 10), F.floor(F.col("high") / 10))))
    cells = cells.withColumnRenamed("coverage", "found")
    met = own.withColumn("cell", F.floor(F.col("at") / 10)).join(cells, "cell").filter((F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")))
    first = lambda c: F.min(F.when(c, F.struct("ord", "found", "code_token")))
    hit = met.groupBy("id").agg(first(F.col("coverage").isNull() | (F.col("found") == F.col("coverage"))).alias("here"), first(F.col("found") != F.col("coverage")).alias("there"))
    out = asked.join(hit, "id", "left")
    covered, elsewhere = F.col("here").isNotNull(), F.col("there").isNotNull()
    verdict = F.when(covered, "보장").when(elsewhere, "미보장").otherwise("판정불가")
    evidence = (
        F.when(covered, F.concat("code", F.lit(" ∈ "), "here.found", F.lit(" 범위 "), "here.code_token"))
        .when(elsewhere, F.concat("code", F.lit("는 "), "there.found", F.lit(" 범위("), "there.code_token", F.lit(") — "), "coverage", F.lit(" 아님")))
        .otherwise(F.concat("code", F.lit(" 어느 범위에도 없음 → RAG/전문가")))
    )
    return out.select("id", "code", verdict.alias("verdict"), F.when(covered, F.col("here.found")).otherwise(F.col("coverage")).alias("coverage"), F.when(~covered & elsewhere, F.col("there.found")).alias("redirect_coverage"), evidence.alias("evidence"))


def effective_coverage() -> Column:
    return F.when(F.col("verdict") == "보장", F.col("coverage")).when(F.col("verdict") == "미보장", F.col("redirect_coverage"))


def reconcile(verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts with the payout of the coverage that pays."""
    asked = verdicts.withColumn("question", F.concat(effective_coverage(), F.lit(" 얼마 지급"))).filter(F.col("question").isNotNull())
    paid = select_payout(asked.select("id", "question"), rules).withColumn("payout", format_payout()).select("id", "payout")
    return verdicts.join(paid, "id", "left")


def format_exclusions(clauses: DataFrame, notes: DataFrame) -> DataFrame:
    """answer for each product: the reasons in clauses (product_id, jo, title, body), in order, and a note for riders that defer (product_id, resolution_note)."""
    tagged = clauses.withColumn("tags", routing.exclusion_tags(F.coalesce("body", F.lit(""))))
    one = tagged.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("jo", "tags"))).alias("c"))
    tags = F.array_join(F.array_distinct(F.flatten(F.transform("c", lambda x: x.tags))), "·")
    refs = F.array_join(F.transform("c", lambda x: F.concat(F.lit("제"), x.jo.cast("string"), F.lit("조"))), " · ")
    base = F.when(tags != "", F.concat(F.lit("지급 제외(면책) 사유: "), tags, F.lit(" 등 ("), refs, F.lit(") — 상세는 해당 조 확인 필요"))).when(refs != "", F.concat(F.lit("지급 제외(면책): "), refs, F.lit(" 참조 — 확인 필요")))
    note = F.coalesce("resolution_note", F.lit(""))
    reference = F.coalesce(F.nullif(F.replace(F.regexp_extract(note, r"제\s*\d+\s*조", 0), F.lit(" "), F.lit("")), F.lit("")), F.lit("주계약"))
    common = F.when(note.contains("준용"), F.concat(F.lit("※ 공통면책(전쟁·임신·위험활동 등)은 "), reference, F.lit(" 준용 소관 — 주계약 미확보로 확인 필요")))
    answer = F.coalesce(F.nullif(F.concat_ws("  ", base, common), F.lit("")), F.lit("면책(지급 제외) 조를 찾지 못했습니다(→RAG)."))
    return notes.join(one, "product_id", "left").select("product_id", answer.alias("answer"))


def cascade(questions: DataFrame, rules: DataFrame, products: DataFrame, ranges: DataFrame, exclusions: DataFrame) -> DataFrame:
    """id, kind, answer: the first rule table that a question's gate opens and that has an answer; else kind rag.

    The order is payout, terms, coverage, exclusion. Each branch joins only the questions of its gate.
    """
    gated = lambda g: questions.filter(routing.gate(g, F.col("question")))
    payout = select_payout(gated("payout"), rules).select("id", format_payout().alias("payout"))
    terms = resolve_product(gated("terms"), products).select("id", format_terms().alias("terms"))
    asked = once(gated("coverage"), {"code": routing.disease_code(F.col("question")), "coverage": routing.first_match(F.col("question"), routing.COVERAGE_HINTS)}).select("id", "code", "coverage").filter(F.col("code").isNotNull())
    coverage = judge_coverage(asked, ranges).select("id", F.concat_ws(" ", "verdict", "coverage", "redirect_coverage", "evidence").alias("coverage"))
    named = resolve_product(gated("exclusion"), products).select("id", "product_id", "resolution_note")
    said = format_exclusions(exclusions, products.select("product_id", "resolution_note"))
    exclusion = named.join(said, "product_id").select("id", F.col("answer").alias("exclusion"))
    out = questions.select("id")
    for branch in (payout, terms, coverage, exclusion):
        out = out.join(branch, "id", "left")
    kinds = ("payout", "terms", "coverage", "exclusion")
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds], F.lit("rag"))
    return out.select("id", kind.alias("kind"), F.coalesce(*kinds).alias("answer"))
