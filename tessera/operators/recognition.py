"""Recognised images: blocks of a layout response, and the chunks that documents get from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

# Labels of blocks that are left out, and of tables.
DROPPED = ["header", "footer", "page_header", "page_footer", "page_number", "page_no", "running_title", "seal", "stamp", "watermark"]
TABLES = ["table", "tableau"]
LEAST_SCORE, SAME_TITLE, SHORTEST_TABLE = 0.5, 0.7, 10
IMAGE_TAG = r"!\[image\s+\d+\]\(([^)]+)\)"


def confident(items: Column, least: float = LEAST_SCORE) -> Column:
    """Items (array of structs with a score) from a score on; one without a score goes."""
    return F.filter(items, lambda x: F.coalesce(x.score >= least, F.lit(False)))


def block_kind(label: Column) -> Column:
    name = F.lower(text.strip(label))
    return F.when(name.isin(DROPPED), "drop").when(name.isin(TABLES), "table").otherwise("text")


def box(x0: Column, y0: Column, x1: Column, y1: Column, bbox: Column) -> Column:
    """Corners of a box from fields of their own or from an array of four: struct<x0, y0, x1, y1> in order of size."""
    at = lambda own, i: F.coalesce(own, F.get(bbox, F.lit(i))).cast("double")
    a, b, c, d = at(x0, 0), at(y0, 1), at(x1, 2), at(y1, 3)
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def table_markdown(html: Column) -> Column:
    """A table's rows and cells as markdown, from HTML without nested tables; the first row is its head."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: text.strip(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))))
    shown = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(cells, F.lit(0)))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, 1_000_000)), "\n")).otherwise("")


def response(blocks: Column) -> Column:
    """struct<text, tables, dropped> of blocks (array<struct<label, text, html>>): texts joined by lines, tables as markdown (or their text), labels left out."""
    own = F.transform(blocks, lambda b: F.struct(block_kind(b.label).alias("kind"), F.lower(text.strip(b.label)).alias("label"), text.strip(F.coalesce(b.text, F.lit(""))).alias("text"), F.coalesce(b.html, F.lit("")).alias("html")))
    of = lambda kind: F.filter(own, lambda b: b.kind == kind)
    tables = F.filter(F.transform(of("table"), lambda b: F.coalesce(F.nullif(table_markdown(b.html), F.lit("")), b.text)), lambda t: t != "")
    texts = F.filter(F.transform(of("text"), lambda b: b.text), lambda t: t != "")
    return F.struct(F.array_join(texts, "\n").alias("text"), tables.alias("tables"), F.transform(of("drop"), lambda b: b.label).alias("dropped"))


def image_tags(lines: DataFrame) -> DataFrame:
    """doc, pos, n, image, heading, page of every image tag in lines (doc, pos, line): the last heading and page mark before it."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    _, title = text.heading(F.col("line"))
    own = lines.withColumns({"heading": F.last(title, ignorenulls=True).over(before), "page": F.last(text.page_of(F.col("line")), ignorenulls=True).over(before)})
    return own.select("doc", "pos", "heading", "page", F.posexplode(F.regexp_extract_all("line", F.lit(IMAGE_TAG), F.lit(1))).alias("n", "image"))


def recognised_chunks(tags: DataFrame, recognised: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks of recognised images: doc, pos, n, part, heading, page, chunk_type, content, char_count.

    tags: as image_tags gives them; recognised: doc, image, text, tables; titles: doc, title, the document's
    headings. A text is left out if it is of no use, or much the same as a heading; a table if it is shorter than ten characters.
    """
    tight = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    held = titles.groupBy("doc").agg(F.collect_set(tight(F.col("title"))).alias("titles"))
    rows = tags.join(recognised, ["doc", "image"]).join(held, "doc", "left").withColumn("t", text.strip(F.coalesce("text", F.lit(""))))
    same = F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda h: text.similarity(tight(F.col("t")), h) > SAME_TITLE)
    keep = (F.col("t") != "") & (text.ocr_verdict(F.col("t")) == "passed") & ~same
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<string>")), text.strip), lambda t: F.length(t) >= SHORTEST_TABLE)
    parts = F.concat(F.when(keep, F.array(F.struct(F.lit("image").alias("chunk_type"), F.col("t").alias("content")))).otherwise(F.array().cast("array<struct<chunk_type: string, content: string>>")), F.transform(tables, lambda t: F.struct(F.lit("table").alias("chunk_type"), t.alias("content"))))
    out = rows.select("doc", "pos", "n", "heading", "page", F.posexplode(parts).alias("part", "c"))
    return out.select("doc", "pos", "n", "part", "heading", "page", "c.chunk_type", "c.content", F.length("c.content").alias("char_count"))


def text_chunk_rows(chunks: DataFrame, strategy: str) -> DataFrame:
    """Chunks (doc, seq, path array, content, start_page, end_page) as rows of the chunk table: heading, heading_path, char_count, part of its section."""
    own = chunks.withColumn("heading_path", F.array_join("path", " > "))
    section = Window.partitionBy("doc", "heading_path")
    return own.select(
        "doc", "seq", F.get("path", F.size("path") - 1).alias("heading"), "heading_path", "content", F.length("content").alias("char_count"), "start_page", "end_page", F.lit("text").alias("chunk_type"), F.lit(strategy).alias("chunk_strategy"),
        F.row_number().over(section.orderBy("seq")).alias("part_index"), F.count("*").over(section).alias("part_total"),
    )


def keep_recognised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of a new chunking with those of the old one that came from images: of type image or table, with recognised texts."""
    return new.unionByName(old.filter(F.col("chunk_type").isin("image", "table") & (F.size(F.coalesce("image_ocr_texts", F.array().cast("array<string>"))) > 0)), allowMissingColumns=True)
