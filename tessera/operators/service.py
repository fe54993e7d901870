"""The service's endpoints as functions of whole frames: answering questions, taking in documents, vectors of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import guards, routing
from tessera.operators import ingest, postings, quality, retrieval, rules, verify
from tessera.operators import models as models_
from tessera.shared import written

#: What a model is asked by type of question; the context and the question follow.
PROMPTS = {
    "structured_lookup": "인용할 조항·별표·표의 원문을 찾아 위치와 함께 그대로 제시하라.",
    "interpretation": "쟁점, 근거, 적용, 결론의 순서로 답하고 근거 조항을 밝혀라.",
    "procedure": "다섯 단계 이내의 번호 목록으로 절차를 적고 단계마다 근거를 밝혀라.",
    "comparison": "비교 항목을 표로 정리하고 차이를 세 문장 이내로 요약하라.",
    "simple_fact": "묻는 사실만 한두 문장으로 답하고 출처를 밝혀라.",
}


@dataclass
class Models:
    """The steps that models do, each a function that workers load what it needs for; the defaults are deterministic stand-ins.

    generate: (prompt, context, question) to an answer; regenerate: with a hint besides; rewrite: a question to another; judge: (answer, context)
    to whether the meaning is reversed; rerank: (questions, index, pairs) to scores; embed: arrays of terms to vectors. Those that need a
    model make their function by models.per_worker(), so that every worker loads it once.
    """

    generate: Callable[[Column, Column, Column], Column] = lambda prompt, context, question: F.concat(question, F.lit("\n"), F.substring(context, 1, 400))
    regenerate: Callable[[Column, Column, Column, Column], Column] = lambda prompt, context, question, hint: F.concat(question, F.lit("\n"), F.substring(context, 1, 400))
    rewrite: Callable[[Column], Column] = lambda question: F.regexp_replace(question, r"[?？]|알려\s*줘|인가요|나요", "")
    judge: Callable[[Column, Column], Column] | None = None
    rerank: Callable[[DataFrame, retrieval.Index, DataFrame], DataFrame] = retrieval.coverage_score
    embed: Callable[[Column], Column] = field(default_factory=models_.hashed)


@dataclass
class Features:
    """Switches of the service, and the words that tell its questions' segments."""

    sql_route: bool = True
    critic: bool = True
    feedback: bool = True
    segment_words: list[str] = field(default_factory=lambda: list(routing.SEGMENT))


@dataclass
class Rules:
    """Tables of the rule path, as rules.cascade() takes them."""

    payout: DataFrame
    products: DataFrame
    ranges: DataFrame
    exclusions: DataFrame


def prompt(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])[kind]


def routed(questions: DataFrame) -> DataFrame:
    """Questions (query_id, question) with personal data masked, what was found, and their route."""
    masked, kinds = guards.mask_pii(F.col("question"))
    own = questions.withColumns({"question": masked, "pii_found": kinds})
    clean, threats = guards.sanitize_input(F.col("question"))
    return own.withColumns({"question": clean, "threats": threats}).withColumn("route", routing.classify(F.col("question")))


def prefetch(questions: DataFrame, index: retrieval.Index, vectors: DataFrame | None, k: int) -> DataFrame:
    """Fused hits of routed questions, each list as long as the question's own factor times k; without vectors the lexical list alone."""
    most = k * 8
    limit = questions.select("query_id", (F.col("route.bm25_factor") * k).alias("lexical_n"), (F.col("route.dense_factor") * k).alias("dense_n"))
    cut = lambda found, n: found.join(limit, "query_id").filter(F.col("rank") <= F.col(n)).select("query_id", "id", "score", "rank")
    lists = [cut(retrieval.bm25(questions, index, most), "lexical_n")]
    if vectors is not None:
        lists.insert(0, cut(retrieval.dense(questions.select("query_id", "vector"), vectors, most), "dense_n"))
    return retrieval.fuse(*lists, limit=k * 3)


def retrieve(questions: DataFrame, chunks: DataFrame | retrieval.Index, vectors: DataFrame | None = None, k: int = 10, models: Models | None = None) -> DataFrame:
    """Hits of routed questions: query_id, id, score, fused, rank. chunks: id, content, or their index."""
    models = models or Models()
    index = chunks if isinstance(chunks, retrieval.Index) else retrieval.build(chunks)
    fused = written(prefetch(questions, index, vectors, k))
    return retrieval.rerank(fused, models.rerank(questions, index, fused), k)


def sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits as a response shows them: query_id, rank, chunk_id, document_id, heading_path, content, scores rounded to four places."""
    own = hits.join(chunks, "id")
    return own.select("query_id", "rank", F.col("id").cast("string").alias("chunk_id"), "document_id", "heading_path", "content", F.round("fused", 4).alias("rrf_score"), F.round("score", 4).alias("rerank_score"))


def by_tables(asked: DataFrame, tables: Rules) -> DataFrame:
    """query_id, kind, told: the routed questions that a rule table answers."""
    return rules.cascade(asked.select(F.col("query_id").alias("id"), "question"), tables.payout, tables.products, tables.ranges, tables.exclusions).filter("kind <> 'rag'").select(F.col("id").alias("query_id"), "kind", F.col("answer").alias("told"))


def answer(questions: DataFrame, chunks: DataFrame, tables: Rules | None = None, vectors: DataFrame | None = None, k: int = 3, models: Models | None = None, features: Features | None = None) -> DataFrame:
    """An answer for every question (query_id, question): the rule tables first, else retrieval, generation and verification.

    chunks: id, document_id, heading_path, part_index, part_total, content. Returns query_id, question (masked),
    strategy, query_type, answer, is_refusal, pii_found, threats, retries, top_score, context_tokens,
    risk, failure, action, groundedness, escalation. Questions without a hit get the refusal.
    """
    models, features = models or Models(), features or Features()
    asked = written(routed(questions))
    none = asked.select("query_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("told")).limit(0)
    told = by_tables(asked, tables) if tables is not None and features.sql_route else none
    by_rule = asked.join(told, "query_id").select("query_id", "question", F.lit("sql").alias("strategy"), "route.query_type", F.col("told").alias("answer"), "pii_found", "threats")
    rest = written(asked.join(told, "query_id", "left_anti"))
    index = retrieval.build(chunks)
    hits = written(retrieval.corrective(rest, lambda q: retrieve(q, index, vectors, k, models), models.rewrite))
    best = hits.groupBy("query_id").agg(F.max("attempt").alias("retries"), F.max("score").alias("top_score"))
    context = retrieval.sections(retrieval.expand_siblings(hits, chunks))
    rows = rest.join(best, "query_id", "left").join(context, "query_id", "left").withColumn("prompt", prompt(F.col("route.query_type")))
    budget = routing.context_budget(F.floor(F.length(F.concat("prompt", "question")) / 2).cast("int"))
    rows = rows.withColumn("context", retrieval.fit_budget(F.coalesce("context", F.lit("")), budget))
    said = F.when(F.col("retries").isNull(), F.lit("관련 내용을 찾지 못했습니다.")).otherwise(models.generate(F.col("prompt"), F.col("context"), F.col("question")))
    rows = verify.verify(written(rows.withColumn("answer", guards.sanitize_output(said)[0])), models.judge)
    again = F.col("failure").isin("generation_error", "unit_error") & F.lit(features.critic)
    gap = F.col("failure").isin("retrieval_gap", "semantic_mismatch") & F.lit(features.critic)
    rows = rows.withColumns({"action": F.when(F.col("risk") == "pass", F.lit(None).cast("string")).when(again, "regenerate").when(gap, "escalate").otherwise("pass")})
    rows = rows.withColumn("answer", F.when(F.col("action") == "regenerate", guards.sanitize_output(models.regenerate(F.col("prompt"), F.col("context"), F.col("question"), F.col("hint")))[0]).otherwise(F.col("answer")))
    by_model = rows.select(
        "query_id", "question", "route.strategy", "route.query_type", "answer", "pii_found", "threats", F.coalesce("retries", F.lit(0)).alias("retries"), "top_score", F.floor(F.length("context") / 2).cast("int").alias("context_tokens"),
        "risk", "failure", "action", "groundedness", F.coalesce(F.col("action") == "escalate", F.lit(False)).alias("escalation"),
    )
    return by_rule.unionByName(by_model, allowMissingColumns=True).withColumn("is_refusal", quality.is_refusal(F.col("answer")))


def assemble(final: Column, payout: Column, reasons: Column, pending: Column, terms: Column, note: Column) -> Column:
    """An answer from what the rule tables tell about a question, a line for each part that is there: verdict, payout, reasons (array) of exclusion, what is to be looked up, terms, note."""
    line = lambda label, c: F.concat(F.lit(f"• {label}"), c)
    named = F.when(F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0, F.array_join(reasons, ", "))
    parts = F.array_compact(F.array(line("보장: ", final), line("지급: ", payout), line("면책 사유: ", named), line("주의: ", pending), line("", terms), line("", note)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.lit("관련 정보를 찾지 못했습니다(→RAG)."))


def citations(claims: DataFrame) -> DataFrame:
    """Claims of verify.provenance() that some chunk supports."""
    return claims.filter(F.size("chunk_ids") > 0)


def take_in(lines: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Documents as lines (doc, pos, line) through the steps of ingestion: clean lines, chunks by the given strategy, vectors, and the tables of a load."""
    clean = ingest.without_contents(lines)
    chunks = chunk(ingest.joined(clean))
    return {"lines": clean, "chunks": chunks, "vectors": None if embed is None else embed(chunks), "tables": ingest.load(lines)}


def embed(rows: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """id and vector of rows (id, content) that have a term, by a model as models.per_worker() makes it: from arrays of terms; a stand-in if none is given."""
    terms = postings.tokens(F.col("content"))
    return rows.select("id", terms.alias("terms")).filter(F.size("terms") > 0).select("id", (model or models_.hashed())(F.col("terms")).alias("vector"))


def run(questions: DataFrame, collect: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], Column]) -> DataFrame:
    """An evaluation loop: answers of all questions, their scores, and the feedback signals that follow from these."""
    answers = collect(questions)
    return answers.withColumn("score", score(answers)).withColumn("signal", routing.signal(F.col("score")))
