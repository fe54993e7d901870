"""Sources and sinks of the engine: traces as JSON lines by day, markdown pages, golden sets, and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Traces as they are written; every field may be absent.
TRACE_SCHEMA = """
trace_id string, timestamp string, endpoint string,
request struct<query: string, service_code: string, document_id: string, start_page: int, end_page: int, include_keywords: array<string>, exclude_keywords: array<string>, top_k: int>,
input_guard struct<pii_found: array<string>, pii_count: int, injection_threats: array<string>>,
route struct<strategy: string, query_type: string, dense_factor: int, bm25_factor: int>,
decomposition struct<method: string, subqueries: array<string>>,
crag struct<retries: int, attempts: array<struct<attempt: int, top_score: double, rewritten_query: string>>, score_before: double, score_after: double>,
retrieval struct<result_count: int, chunk_ids: array<string>, rerank_scores: array<double>, rerank_stats: struct<min: double, max: double, mean: double>>,
sibling struct<expanded_section_count: int, total_chars: int>, context struct<truncated: boolean, token_budget: int, final_tokens: int>,
verification struct<risk_level: string, claims_count: int, verifiable_claims_count: int, supported_claims_count: int, missing_refs_count: int, numeric_mismatch_count: int, groundedness: double>,
critic struct<invoked: boolean, failure_type: string, action_taken: string, before_risk: string, after_risk: string, regenerate_improved: boolean>,
answer struct<length_chars: int, is_refusal: boolean>, output_guard struct<threats: array<string>>, timing_ms map<string, double>, error struct<type: string, message: string>, _corrupt string
"""


def read_traces(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, endpoint: str | None = None, service_code: str | None = None) -> DataFrame:
    """Traces of a range of days; the partition filter prunes folders, and lines that are no JSON are left out."""
    rows = spark.read.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if first is not None:
        rows = rows.filter(F.col("date") >= first)
    if last is not None:
        rows = rows.filter(F.col("date") <= last)
    if endpoint is not None:
        rows = rows.filter(F.col("endpoint") == endpoint)
    if service_code is not None:
        rows = rows.filter(F.col("request.service_code") == service_code)
    return rows.filter(F.col("_corrupt").isNull() & F.col("trace_id").isNotNull()).drop("_corrupt")


def write_traces(traces: DataFrame, path: str) -> None:
    """Appends traces as JSON lines under the day of their timestamp."""
    traces.withColumn("date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("date").json(path)


def markdown_pages(docs: DataFrame) -> DataFrame:
    """doc, page, content of texts (doc, text) cut at page markers; what is before the first has no page."""
    pages = F.regexp_extract_all("text", F.lit(r"<!-- page:(\d+) -->"), F.lit(1))
    parts = F.split("text", r"<!-- page:\d+ -->")
    numbered = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), pages).alias("page"), parts.alias("content"))
    return docs.select("doc", F.explode(numbered).alias("p")).select("doc", F.col("p.page").cast("int").alias("page"), F.regexp_replace("p.content", r"^\s+|\s+$", "").alias("content")).filter("page is not null or content <> ''")


@F.udtf(returnType="page int, id int, depth int, x0 double, y1 double, level int, content string")
class LayoutNodes:
    """Text nodes of one layout tree (JSON with nested `kids`), in reading order: a table function, in SQL as layout_nodes(tree)."""

    def eval(self, tree: str | None) -> Iterator[tuple]:
        try:
            stack = [(json.loads(tree), 0)] if tree else []
        except (ValueError, RecursionError):
            return
        i = 0
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                stack += [(kid, depth) for kid in reversed(node)]
            elif isinstance(node, dict):
                kids = node.get("kids")
                stack += [(kid, depth + 1) for kid in reversed(kids)] if isinstance(kids, list) else []
                if node.get("content"):
                    box = node.get("bounding box")
                    box = [*(box if isinstance(box, list) else []), None, None, None, None]
                    yield _whole(node.get("page number")), i, depth, _real(box[0]), _real(box[3]), _whole(node.get("heading level")), str(node["content"])
                    i += 1


def _whole(x: object) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1 << 31 else None


def _real(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def layout_nodes(spark: SparkSession, trees: DataFrame) -> DataFrame:
    """doc, page, id, depth, x0, y1, level, content of all text nodes of layout trees (doc, tree as JSON), however deep.

    Nodes come out row by row, so a tree's nodes are never held together. A tree that is null, empty or no JSON has none; a page, place or
    level that is no number is null.
    """
    nodes = LayoutNodes(F.col("tree").outer())
    return trees.select("doc", "tree").lateralJoin(nodes).select("doc", "page", "id", "depth", "x0", "y1", "level", "content")


def register_functions(spark: SparkSession) -> None:
    """layout_nodes for SQL: select doc, n.* from trees, lateral layout_nodes(tree) n."""
    spark.udtf.register("layout_nodes", LayoutNodes)


def write_report(section: DataFrame, path: str) -> None:
    """A section of a report as JSON lines."""
    section.write.mode("overwrite").json(path)


GOLDEN_SCHEMA = "doc string, section string, field string, expected string, evidence string, labeler string"


def read_golden(spark: SparkSession, path: str, schema: str = GOLDEN_SCHEMA) -> DataFrame:
    """Rows of a golden set in JSON lines; lines that are no JSON are left out."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The measures of a report in JSON, one object a file: metric, value, in long form; null where the report has none."""
    rows = spark.read.schema("measures map<string, double>, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(F.explode_outer("measures").alias("metric", "value")).filter("metric is not null")


def scroll(points: DataFrame, payload: list[str], after=None, page: int = 1000) -> DataFrame:
    """The next page of points by id with some of their payload: a full scan goes on from the last id of the page before."""
    rows = points if after is None else points.filter(F.col("id") > after)
    return rows.select("id", *payload).orderBy("id").limit(page)


def sample(points: DataFrame, n: int) -> DataFrame:
    """n points (id and others) of least hash of their id: the same ones whenever asked."""
    return points.orderBy(F.xxhash64("id"), "id").limit(n)


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path and page count of PDF files, as their bytes state it."""
    from tessera.functions import text

    return spark.read.format("binaryFile").load(path).select("path", text.pdf_pages(F.col("content")).alias("pages"))
