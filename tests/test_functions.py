import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import facts, routing, text
from tessera.operators import verify as v


def value(spark, t, column):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("t,want", [("제43조 제2항 제1호", ["제43조 제2항 제1호"]), ("제 3 조와 제4조", ["제3조", "제4조"]), ("제5조 제0항", ["제5조"]), ("없음", [])])
def test_articles(spark, t, want):
    assert value(spark, t, facts.canonicals(facts.article_refs(F.col("t")))) == want


def test_appendices_and_numbers(spark):
    assert value(spark, "별표 1, 부칙 제2조, 부칙, 서식 3 양식4", facts.canonicals(facts.appendix_refs(F.col("t")))) == ["별표 1", "부칙 제2조", "부칙", "서식 3", "양식 4"]
    got = value(spark, "1,200만원 5억 원 30% 3개월 10일 숫자 77 2024.1.2", facts.numeric_facts(F.col("t")))
    assert [n.canonical for n in got] == ["12000000.0:KRW", "500000000.0:KRW", "30.0:PERCENT", "90.0:DAYS", "10.0:DAYS", "0:DATE"]


def test_claims(spark):
    assert value(spark, "지급한다. 그렇다 아니다\n\n 끝!  더", facts.claims(F.col("t"))) == ["지급한다.", "그렇다", "아니다", "끝!", "더"]


CHECKS = [
    ("제3조에 따라 30%를 지급한다.", "제3조(지급) 30% 지급", "pass", "minor"),
    ("제4조에 따라 지급한다.", "제3조 지급", "hard_fail", "generation_error"),
    ("제40조에 따라 지급한다.", "제3조 지급", "hard_fail", "retrieval_gap"),
    ("1,200만원을 지급한다.", "1,000만원 지급", "soft_fail", "unit_error"),
    ("5억원을 지급한다.", "100만원 지급", "soft_fail", "minor"),
    ("15세 이상이다.", "20세 이상", "warn", "minor"),
    ("별표 2 참조", "별표 1", "hard_fail", "retrieval_gap"),
    ("제3조 제2항을 본다.", "제3조 제1항", "pass", "minor"),
]


@pytest.mark.parametrize("answer,context,risk,failure", CHECKS)
def test_verify(spark, answer, context, risk, failure):
    got = v.verify(spark.createDataFrame([(answer, context)], "answer string, context string")).first()
    assert (got.risk, got.failure) == (risk, failure)


def test_provenance(spark):
    answers = spark.createDataFrame([(1, "제3조에 따른다. 별표 1을 본다. 좋다.")], "id int, answer string")
    chunks = spark.createDataFrame([(1, "b", "제3조 제2항"), (1, "a", "제3조"), (1, "c", "별표1")], "id int, chunk_id string, content string")
    got = [r.chunk_ids for r in v.provenance(answers, chunks).orderBy("claim_no").collect()]
    assert got == [["a", "b"], ["c"], []]


ROUTES = [
    ("제43조 내용", "bm25_heavy", "structured_lookup"), ("별표 3", "bm25_heavy", "structured_lookup"), ("청구 절차 알려줘", "dense_heavy", "procedure"), ("A와 B의 차이", "dense_heavy", "comparison"),
    ("어떻게 정의되나요", "dense_heavy", "interpretation"), ("제3조의 의미는", "hybrid", "interpretation"), ("보험료", "hybrid", "simple_fact"), ("제2조 신청 방법", "hybrid", "procedure"),
]


@pytest.mark.parametrize("question,strategy,kind", ROUTES)
def test_routes(spark, question, strategy, kind):
    got = value(spark, question, routing.classify(F.col("t")))
    assert (got.strategy, got.query_type) == (strategy, kind)


def test_text(spark):
    assert value(spark, "a\u3000b\ufeff \u201cx\u201d \u2013 \u2460  \t\n\n\n\nc", text.normalize(F.col("t"))) == 'a b "x" - 1\n\nc'
    assert value(spark, "재해분류표 재해분류표", text.dedup_title(F.col("t"))) == "재해분류표"
    assert value(spark, "part-1", text.uuid5(str(uuid.NAMESPACE_URL), F.col("t"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "part-1"))
    assert value(spark, "<!-- page:3 -->\nx\n<!-- page:1 -->", F.array(*text.page_range(F.col("t")))) == [1, 3]
    assert value(spark, "abc", text.similarity(F.col("t"), F.lit("abd"))) == pytest.approx(1 / 3)
    assert value(spark, "ab\n12345 67890", text.ocr_verdict(F.col("t"))) == "low_lang_ratio"
    assert value(spark, "－ＡＢ", text.nfkc(F.col("t"))) == "-AB"


@pytest.mark.parametrize("body,tags", [("고의로 사고를 낸 경우와 전쟁", ["고의", "전쟁내란"]), ("음주운전, 무면허", ["무면허운전", "음주운전"]), ("없음", [])])
def test_exclusion_tags(spark, body, tags):
    assert value(spark, body, routing.exclusion_tags(F.col("t"))) == tags
