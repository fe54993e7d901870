import json

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import chunking, evaluation, ranks, retrieval, rules, state, structure, traces
from tessera.plans import rules_pack

RULE = "ord int, coverage string, cause string, age_band string, period_bucket string, rate_pct int, per_unit string, limit_days int, reduction_rate_pct int, reduction_period string, reduction_cause string"


def payout_rules(spark):
    rows = [(1, "중환자실치료급여금", None, None, None, 1, "1일당", 60), (2, "레진치료", "질병", None, "90일이하", 0, None, None), (3, "레진치료", "질병", None, "90일초과1년미만", 50, None, None), (4, "레진치료", "상해", None, None, 100, None, None), (5, "소득보장 12개월", None, None, None, 30, None, None), (6, "소득보장 6개월", None, None, None, 20, None, None)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], RULE)


@pytest.mark.parametrize("question,rate", [("중환자실 하루 얼마", 1), ("레진 질병 반년 얼마", 50), ("레진 재해가 아닌 경우 90일 이내", 0), ("레진 다쳐서 얼마", 100), ("소득보장 6개월 얼마", 20), ("중환자실 질병 얼마", 1), ("치아 얼마", None)])
def test_payout(spark, question, rate):
    got = rules.select_payout(spark.createDataFrame([(1, question)], "id int, question string"), payout_rules(spark)).collect()
    assert [r.rate_pct for r in got] == ([] if rate is None else [rate])


@pytest.mark.parametrize("code,coverage,verdict,redirect", [("C50", "암진단자금", "보장", None), ("C16", "암진단자금", "보장", None), ("D45", "암진단자금", "보장", None), ("D05", "암진단자금", "미보장", "제자리암진단자금"), ("D05", "제자리암진단자금", "보장", None), ("D41", "경계성종양진단자금", "보장", None), ("Z99", "암진단자금", "판정불가", None), ("C26.6", None, "판정불가", None)])
def test_coverage(spark, code, coverage, verdict, redirect):
    got = rules.judge_coverage(spark.createDataFrame([(1, code, coverage)], "id int, code string, coverage string"), spark.sql(rules_pack.RANGES)).first()
    assert (got.verdict, got.redirect_coverage) == (verdict, redirect)


def lines(spark, text):
    return spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))], "doc long, pos int, line string")


def test_runs_and_refs(spark):
    text = "## 가 특별약관\n제1조(목적) 이 약관은\n제2조(지급) 제1조와 별표 1, 의료법 제9조\n## 나 특별약관\n제1조(목적) x\n본문\n제3조(기타) y"
    got = structure.clauses(lines(spark, text))
    assert [(r.run, r.jo) for r in got.orderBy("first_pos").collect()] == [(0, 1), (0, 2), (1, 1), (1, 3)]
    assert [(r.run, r.structure) for r in structure.clause_integrity(got).orderBy("run").collect()] == [(0, "clean"), (1, "gap")]
    assert {(r.ref_type, r.target, r.resolved) for r in structure.clause_refs(got).collect()} == {("조항", 1, True), ("별표", 1, False)}


def test_heading_path_without_contents(spark):
    got = structure.heading_paths(lines(spark, "# A\n## 목차\n### B\nx\n# C\ny")).orderBy("pos").collect()
    assert [r.path for r in got] == ["A", "A", "A > B", "A > B", "C", "C"]


def test_reading_order(spark):
    nodes = [(1, 1, i, x, y) for i, (x, y) in enumerate([(300.0, 700.0), (50.0, 700.0), (52.0, 400.0), (301.0, 300.0)])]
    got = structure.reading_order(spark.createDataFrame(nodes, "doc long, page int, id int, x0 double, y1 double")).orderBy("place").collect()
    assert [r.id for r in got] == [1, 2, 0, 3]


def test_subitems():
    got = chunking.subitems("① 첫째\n1. 가\n가. 나\n나. 다\n3. 아님\n② 둘째\n④ 아님\n이어서")
    assert [(p["hang"], len(p["hos"])) for p in got] == [(1, 1), (2, 0)]
    assert [m["mok"] for m in got[0]["hos"][0]["moks"]] == ["가", "나"]
    assert got[1]["text"].endswith("이어서")
    assert chunking.subitems("1. a\n2. b")[0]["hang"] == 0


def test_chunks():
    text = "\n\n".join(f"단락 {i} " + "가나다. " * 60 for i in range(12))
    parts = chunking.paragraphs(text)
    assert all(len(p) <= chunking.TEXT_MAX + chunking.LEAST + 2 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    table = "\n".join(["| a | b |", "|---|---|"] + [f"| {i} | {'x' * 50} |" for i in range(100)])
    pieces = chunking.table_rows(table)
    assert all(p.startswith("| a | b |\n|---|---|") and len(p) <= chunking.TABLE_MAX for p in pieces)
    assert sum(p.count("x" * 50) for p in pieces) == 100
    spans = list(chunking.windows("word " * 500))
    assert spans[0][0] == 0 and all(b[0] < a[1] for a, b in zip(spans, spans[1:]))
    assert chunking.html_table("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_histogram_and_percentile(spark):
    bins = spark.createDataFrame([(x,) for x in (0.3, 0.6, 0.7, -0.1, 1.0, 1.7)], "x double").select(evaluation.histogram_bin(F.col("x")).alias("b")).collect()
    assert [r.b for r in bins] == [2, 5, 6, 0, 9, 9]
    for n, want in ((99, 49.0), (100, 49.5)):
        got = ranks.percentiles(spark.range(n), [], "id", {"p": 50}).first().p
        assert got == want


def test_budget_and_siblings(spark):
    context = "\n\n---\n\n".join(["a" * 40, "b" * 400, "c" * 40])
    got = spark.createDataFrame([(context,)], "c string").select(retrieval.fit_budget(F.col("c"), 50).alias("x")).first().x
    assert got == "a" * 40 + "\n\n---\n\n" + "c" * 40
    chunks = spark.createDataFrame([(i, "d", "h", i, 9, f"c{i}") for i in range(1, 10)], "id long, document_id string, heading_path string, part_index int, part_total int, content string")
    hits = spark.createDataFrame([(1, 2, 1)], "query_id long, id long, rank int")
    assert retrieval.sections(retrieval.expand_siblings(hits, chunks)).first().context == "h\n\nc1\n\nc2\n\nc3\n\nc4"


def test_corrective_search_rewrites(spark):
    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, content string")

    def search(questions):
        index = retrieval.build(corpus)
        return retrieval.bm25(questions, index, 3)

    questions = spark.createDataFrame([(1, "alpha"), (2, "unknown")], "query_id long, question string")
    got = retrieval.corrective(questions, search, lambda q: F.lit("gamma"), threshold=0.1).collect()
    assert sorted((r.query_id, r.id, r.attempt) for r in got) == [(1, 1, 0), (2, 2, 1)]


def test_state(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "document_id int, v int")
    state.replace_documents(spark, make([(1, 1), (2, 2)]), path)
    state.replace_documents(spark, make([(2, 5), (2, 6)]), path)
    assert sorted((r.document_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5), (2, 6)]
    with pytest.raises(Exception, match="not valid"):
        state.checked(make([(1, -1)]), positive=F.col("v") > 0).collect()


def test_trace_source(spark, tmp_path):
    for day, n in (("2026-01-01", 2), ("2026-01-02", 1)):
        folder = tmp_path / f"date={day}"
        folder.mkdir()
        rows = [json.dumps({"trace_id": f"{day}-{i}", "endpoint": "answer", "new_field": 1, "timing_ms": {"total": 3.5}}) for i in range(n)]
        (folder / "traces.jsonl").write_text("\n".join([*rows, "{broken"]))
    assert sources.read_traces(spark, str(tmp_path)).count() == 3
    got = sources.read_traces(spark, str(tmp_path), first="2026-01-02", endpoint="answer").collect()
    assert [(r.trace_id, r.timing_ms["total"]) for r in got] == [("2026-01-02-0", 3.5)]


def test_pages_and_layout(spark):
    docs = spark.createDataFrame([(1, "a<!-- page:2 -->b<!-- page:3 -->")], "doc long, text string")
    assert [(r.page, r.content) for r in sources.markdown_pages(docs).collect()] == [(None, "a"), (2, "b"), (3, "")]
    tree = json.dumps({"kids": [{"content": "x", "page number": 1, "bounding box": [1.0, 2, 3, 4.0], "kids": [{"content": "y", "heading level": 2}]}]})
    got = sources.layout_nodes(spark, spark.createDataFrame([(1, tree)], "doc long, tree string")).orderBy("id").collect()
    assert [(r.content, r.page) for r in got] == [("x", 1), ("y", None)]
    assert (got[0].x0, got[0].y1) == (1.0, 4.0)


def test_feedback_rates(spark):
    t = spark.createDataFrame([(str(i), "pass", [0.85]) for i in range(9)], "trace_id string, risk string, scores array<double>")
    s = spark.createDataFrame([(str(i), "up") for i in range(10)], "trace_id string, signal string")
    got = traces.feedback(s, t).first()
    assert (got.n, got.match_rate, got.mean_top1) == (10, 0.9, 0.85)
