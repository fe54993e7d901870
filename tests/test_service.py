import json

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import routing, text
from tessera.operators import chunking, ingest, quality, recognition, retrieval, service, state
from tessera.operators.barrier import once
from tests.test_operators import lines

CHUNKS = [
    (1, "d1", "제1장 > 제3조", 1, 2, "제3조(지급사유) 회사는 입원급여금 5만원을 지급합니다."), (2, "d1", "제1장 > 제3조", 2, 2, "다만 면책 기간 90일에는 지급하지 않습니다."),
    (3, "d2", "제2장 > 제7조", 1, 1, "제7조(청약철회) 계약자는 15일 이내에 청약을 철회할 수 있습니다."), (4, "d2", "", 1, 1, None),
]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id long, document_id string, heading_path string, part_index int, part_total int, content string")


def questions(spark, *rows):
    return spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "query_id long, question string")


def test_answers(spark):
    asked = questions(spark, "제3조 입원급여금 지급사유", "청약을 철회할 수 있습니다 15일 이내에", "전혀 다른 우주선", "제 번호는 010-1234-5678 입원급여금")
    got = {r.query_id: r for r in service.answer(asked, chunks(spark)).collect()}
    assert len(got) == 4
    assert "입원급여금" in got[0].answer and not got[0].is_refusal and got[0].query_type == "structured_lookup"
    assert got[2].is_refusal and got[2].answer == "관련 내용을 찾지 못했습니다."
    assert "PHONE" in got[3].question and "010-1234" not in got[3].question and got[3].pii_found
    assert service.answer(asked.limit(0), chunks(spark)).count() == 0
    assert service.answer(asked, chunks(spark).limit(0)).filter("not is_refusal").count() == 0


def test_a_bad_answer_is_made_anew_or_passed_on(spark):
    wrong = service.Models(generate=lambda p, c, q: F.lit("제3조에 따라 7만원을 지급합니다."), regenerate=lambda p, c, q, h: F.lit("제3조에 따라 5만원을 지급합니다."))
    row = service.answer(questions(spark, "제3조 입원급여금 지급사유"), chunks(spark), models=wrong).first()
    assert (row.failure, row.action) in {("unit_error", "regenerate"), ("generation_error", "regenerate")} and "5만원" in row.answer
    gone = service.Models(generate=lambda p, c, q: F.lit("제99조에 따라 지급합니다."))
    row = service.answer(questions(spark, "제3조 입원급여금 지급사유"), chunks(spark), models=gone).first()
    assert row.risk == "hard_fail"
    off = service.answer(questions(spark, "제3조 입원급여금 지급사유"), chunks(spark), models=wrong, features=service.Features(critic=False)).first()
    assert "7만원" in off.answer


def test_taking_documents_in(spark):
    text_of = "# 무배당 암보험\n## 목차\n제1조 3\n## 보통약관\n제1조(목적) 정합니다.\n제2조(지급사유) 보험수익자에게 암진단자금 (별표 1) 을 드립니다.\n(별표1) 지급기준표\n| a | b |"
    found = service.take_in(lines(spark, text_of), chunking.fixed_chunks, lambda c: service.embed(c.select((F.col("doc") * 1000 + F.col("part")).alias("id"), "content")))
    assert [r.line for r in found["lines"].orderBy("pos").collect()][1] == "## 보통약관"
    assert found["chunks"].count() == 1 and found["vectors"].count() == 1
    tables = found["tables"]
    assert tables["product"].first().coverage_name == "암진단자금" and tables["product"].first().payout_annex == 1
    assert {(r.check, r.verdict) for r in tables["gate"].collect()} >= {("in_order", "PASS"), ("clauses", "FAIL"), ("annexes", "PASS")}
    assert all(isinstance(t.count(), int) for t in tables.values())


def test_diagnosis(spark):
    nan = float("nan")
    rows = [(1, None, None, 0.9, 0.9, False), (2, 0.5, 0.5, 0.9, 0.9, False), (3, 0.99, 0.1, 0.5, 0.9, False), (4, 0.99, 0.1, nan, 0.5, True), (5, 0.99, None, 0.9, None, False), (6, 0.99, 0.9, nan, None, False)]
    got = quality.diagnose(spark.createDataFrame(rows, "run int, recall_5 double, recall_3 double, faithfulness double, relevancy double, biased boolean")).orderBy("run").collect()
    assert [r.verdict for r in got] == ["unknown", "retrieval-bound", "generation-bound", "generation-leaning", "healthy", "unknown"]


@pytest.mark.parametrize("line,want", [
    ("- 제15조 【갱신】 이어진 본문", ["##### 제15조 【갱신】", "이어진 본문"]), ("제3조(지급사유)에서 정한", ["제3조(지급사유)에서 정한"]), ("제3조(지급사유)", ["##### 제3조(지급사유)"]),
    ("###### 기준으로 합니다.", ["기준으로 합니다."]), ("## 제1장 끝낸다.", ["## 제1장 끝낸다."]), ("목적 ........ 3", []), ("a<br>b ![](x.png)", ["a b "]),
])
def test_repaired_lines(spark, line, want):
    assert spark.range(1).select(text.repaired_line(F.lit(line)).alias("x")).first().x == want


@pytest.mark.parametrize("line,want", [("###### 3. 상해수술비(간편가입)", "3. 상해수술비(간편가입)"), ("## 2-1. 담보", "2-1. 담보"), ("3. 본문", None), ("## 제3조(정의)", None), ("## 4. 용어의 뜻", None), ("## 5. ", None)])
def test_rider_titles(spark, line, want):
    assert spark.range(1).select(text.rider_title(F.lit(line)).alias("x")).first().x == want


def test_recognised_blocks(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x<br>y</td></tr></table>"
    blocks = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(t).cast("string").alias("text"), F.lit(h).cast("string").alias("html")) for label, t, h in ((" Footer", "7", None), ("table", "", html), ("text", " 본문 ", None), ("Title", None, None))])
    r = spark.range(1).select(recognition.response(blocks).alias("r")).first().r
    assert (r.text, r.tables, r.dropped) == ("본문", ["| a | b |\n|---|---|\n| 1 | x y |"], ["footer"])


def test_sources_of_little_use(spark, tmp_path):
    trees = spark.createDataFrame([(1, None), (2, "no json"), (3, json.dumps({"kids": [{"content": "x", "page number": 1}, "odd"]})), (4, "[]")], "doc long, tree string")
    assert [(r.doc, r.content) for r in sources.layout_nodes(spark, trees).collect()] == [(3, "x")]
    (tmp_path / "g.jsonl").write_text(json.dumps({"doc": "d", "field": "f", "expected": "1"}) + "\n{bad\n")
    assert [r.doc for r in sources.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == ["d"]
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Count 3 \xff /Count 12")
    (tmp_path / "b.pdf").write_bytes(b"none")
    assert sorted(r.pages for r in sources.read_pdf_pages(spark, f"{tmp_path}/*.pdf").collect()) == [12, 200]
    points = spark.range(10).withColumn("x", F.col("id") * 2)
    first = [r.id for r in sources.scroll(points, ["x"], page=4).collect()]
    assert first == [0, 1, 2, 3] and [r.id for r in sources.scroll(points, ["x"], first[-1], 4).collect()] == [4, 5, 6, 7]
    assert sources.sample(points, 3).count() == 3


def test_dense_search_without_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, None]), (4, [0.6, 0.8])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.id) for r in retrieval.dense(asked, vectors, 5).orderBy("rank").collect()] == [(7, 1), (7, 4)]
    assert retrieval.dense(asked.limit(0), vectors, 5).count() == 0


def test_small_ones(spark):
    d = spark.createDataFrame([("갱신이 되나요",), ("날씨",)], "q string")
    assert [r[0] for r in d.select(routing.segment(F.col("q"))).collect()] == ["domain", "general"]
    kept = once(d, {"n": F.length("q")})
    assert kept.columns == ["q", "n"] and [r.n for r in kept.collect()] == [7, 2]
    assert state.count_by(d, "q").count() == 2
    p = ingest.with_subitems(spark.createDataFrame([("① 가\n1. 하나\n가. 첫째\n2. 둘\n② 나",), ("1. 항 없는 호",), (None,)], "body string"))
    assert [(r.n_hang, r.n_ho, r.n_mok) for r in p.collect()] == [(2, 2, 1), (0, 1, 0), (0, 0, 0)]
