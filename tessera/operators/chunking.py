"""Chunks of markdown: kernels that depend on what they have packed so far, run once for each document in Arrow batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import structure

#: Characters of a text, table and least chunk; of a window and its overlap.
TEXT_MAX, TABLE_MAX, LEAST, WINDOW, OVERLAP = 1200, 2400, 300, 800, 150
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
SYLLABLES = "가나다라마바사아자차카타파하"


def windows(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(start, end, chunk) of overlapping windows that end at a line, word or sentence end in their second half."""
    if len(text) <= size:
        if text:
            yield 0, len(text), text
        return
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(mark, at, end) for mark in "\n .") - at
            if cut > size / 2:
                end = at + cut + 1
        piece = text[at:end].strip()
        if piece:
            yield at, end, piece
        step = end - at - overlap
        at += step if step > 0 else size // 2


def pack(parts: list[str], most: int, joint: str) -> list[str]:
    """Parts joined in order as long as the whole is no longer than most."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) + len(joint) <= most:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def sentences(text: str, most: int) -> list[str]:
    parts = [s.strip() for s in re.split(r"(?<=\.)\s+", text) if s.strip()]
    return pack(parts, most, " ") if len(parts) > 1 else [text]


def paragraphs(text: str, most: int = TEXT_MAX, least: int = LEAST) -> list[str]:
    """Paragraphs packed to chunks; a paragraph too long is cut at sentences. A short last chunk joins the one before."""
    out: list[str] = []
    run: list[str] = []
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(part) > most:
            out += pack(run, most, "\n\n") + sentences(part, most)
            run = []
        elif part:
            run.append(part)
    out = pack(out + pack(run, most, "\n\n"), most, "\n\n")
    if len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += "\n\n" + last
    return out


def table_rows(text: str, most: int = TABLE_MAX) -> list[str]:
    """A table in pieces of whole rows, each under the table's head."""
    rows = text.split("\n")
    heads = 2 if len(rows) > 1 and re.match(r"^\|?[\s\-:|]+\|?$", rows[1].strip()) else 1
    if len(text) <= most or len(rows) <= 2 or not rows[heads:]:
        return [text]
    head = "\n".join(rows[:heads])
    return [head + "\n" + body for body in pack(rows[heads:], most - len(head) - 2, "\n")]


def html_table(html: str) -> str:
    """Rows and cells of an HTML table as a markdown table; without rows as it is."""
    rows = [[re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", c)).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html)]
    rows = [r for r in rows if r]
    if not rows:
        return html
    width = max(map(len, rows))
    shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([shown[0], "|" + " --- |" * width, *shown[1:]])


def subitems(body: str) -> list[dict]:
    """Paragraphs, items and sub-items of a clause; a mark counts only in its turn, else the line goes on with what is open."""
    out: list[dict] = []
    item: dict | None = None
    for line in filter(None, map(str.strip, body.splitlines())):
        bare = line.lstrip("-•* \t")
        if bare[:1] in CIRCLED and bare and (n := sum(p["hang"] > 0 for p in out)) < len(CIRCLED) and bare[0] == CIRCLED[len(out)] and n == len(out):
            out.append({"hang": n + 1, "text": bare[1:].strip(), "hos": [], "moks": []})
            item = None
            continue
        if m := re.match(r"(\d{1,2})\.\s+(.*)$", bare):
            if not out:
                out.append({"hang": 0, "text": "", "hos": [], "moks": []})
            if int(m[1]) == len(out[-1]["hos"]) + 1:
                item = {"ho": int(m[1]), "text": m[2].strip(), "moks": []}
                out[-1]["hos"].append(item)
                continue
        if (m := re.match(r"([가-힣])\.\s+(.*)$", bare)) and out:
            under = (item or out[-1])["moks"]
            if len(under) < len(SYLLABLES) and m[1] == SYLLABLES[len(under)]:
                under.append({"mok": m[1], "text": m[2].strip()})
                continue
        if out:
            open_part = item or out[-1]
            open_part["text"] = f"{open_part['text']} {line}".strip()
    return out


def fixed_chunks(docs: DataFrame) -> DataFrame:
    """doc, part, first, end, content of overlapping windows of each text (doc, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, i, a, b, c) for doc, text in zip(frame.doc, frame.text) for i, (a, b, c) in enumerate(windows(text or ""), 1)]
            yield pd.DataFrame(rows, columns=["doc", "part", "first", "end", "content"])

    return docs.select("doc", "text").mapInPandas(run, "doc bigint, part int, first int, end int, content string")


#: What str.strip() and \s of re take for white space, as Arrow's patterns have it.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]:
    """doc, path, first position, table, content of the blocks in batches of structure.headed_lines(); the last of a batch is kept, as it may go on in the next."""
    head, lines = None, []
    for batch in batches:
        doc, pos, path, table, line = batch.columns
        starts = np.flatnonzero(path.is_valid().to_numpy(zero_copy_only=False))
        if not len(starts):
            lines.append(line)
            continue
        if head is not None:
            lines.append(line.slice(0, starts[0]))
            yield *head, pa.array(["\n".join(x for part in lines for x in part.drop_null().to_pylist())], pa.string())
        if len(starts) > 1:
            ends = np.concatenate([[0], np.cumsum(line.is_valid().to_numpy(zero_copy_only=False))])[starts]
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line.drop_null())
            whole = pa.array(starts[:-1])
            yield doc.take(whole), path.take(whole), pos.take(whole), table.take(whole), pc.binary_join(each, "\n")
        last = starts[-1]
        head, lines = [c.slice(last, 1) for c in (doc, path, pos, table)], [line.slice(last)]
    if head is not None:
        yield *head, pa.array(["\n".join(x for part in lines for x in part.drop_null().to_pylist())], pa.string())


def adaptive_chunks(lines: DataFrame) -> DataFrame:
    """doc, path, part_index, part_total, kind, content: blocks of lines (doc, pos, line), as structure.headed_lines() has them, cut to size and numbered within their heading.

    A block is joined in one task. Only those that may have to be cut go through the kernels; the others are their own single part.
    """
    marked = structure.headed_lines(lines)
    names = ["doc", "path", "first_pos", "i", "table", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, path, pos, table, content in _blocks_of(batches):
            content = pc.utf8_trim(content, " \t\n\x0b\f\r")
            size = pc.utf8_length(content)
            cut = pc.if_else(table, pc.greater(size, TABLE_MAX), pc.or_(pc.greater(size, TEXT_MAX), pc.match_substring_regex(content, rf"\A{BLANK}|{BLANK}\z|\n{BLANK}*\n")))
            whole = pc.and_not(pc.greater(size, 0), cut)
            columns = [doc, path, pos, pa.array(np.zeros(len(doc), np.int32)), table, content]
            yield pa.RecordBatch.from_arrays([c.filter(whole) for c in columns], names)
            if pc.any(cut).as_py():
                parts = [table_rows(c) if t else paragraphs(c) for t, c in zip(table.filter(cut).to_pylist(), content.filter(cut).to_pylist())]
                at = pa.array(np.repeat(np.flatnonzero(cut.to_numpy(zero_copy_only=False)), [len(p) for p in parts]))
                i = pa.array([k for p in parts for k in range(len(p))], pa.int32())
                yield pa.RecordBatch.from_arrays([doc.take(at), path.take(at), pos.take(at), i, table.take(at), pa.array([c for p in parts for c in p], pa.string())], names)

    doc, pos = (marked.schema[n].dataType.simpleString() for n in ("doc", "pos"))
    parts = marked.mapInArrow(run, f"doc {doc}, path string, first_pos {pos}, i int, table boolean, content string")
    own = Window.partitionBy("doc", "path")
    kind = F.when(F.col("table"), "table").otherwise("text").alias("kind")
    return parts.select("doc", "path", F.row_number().over(own.orderBy("first_pos", "i")).alias("part_index"), F.count("*").over(own).alias("part_total"), kind, "content")


NOISE = re.compile(r"!\[image\s+\d+\]|.*·{5}|.*…{3}|[-–—]\s*\d+\s*[-–—]$|\d+\s*[-–—]$|(?i:page\s+)?\d+\s*/\s*\d+$|(?i:page)\s+\d+\s+(?i:of)\s+\d+$", re.DOTALL)


def _is_table(line: str) -> bool:
    line = line.strip()
    return line.startswith("|") and line.endswith("|")


def blocks(lines: list[str]) -> list[tuple[bool, list[str]]]:
    """Runs of table lines (true) and of others, in order."""
    return [(kind, list(run)) for kind, run in itertools.groupby(lines, _is_table)]


def clean(raw: str) -> str:
    """A node's text without tables of one column, page marks and noise, as text.is_noise_line() and structure.junk_tables() have them by line."""
    kept: list[str] = []
    for table, run in blocks(raw.split("\n")):
        inner = [line.strip().strip("|") for line in run]
        if not table or any("|" in x and not re.match(r"[\s\-:]+$", x) for x in inner):
            kept += run
    marks = (s for s in kept if not re.match(tx.PAGE_MARKER, s))
    solid = (s for s in marks if not NOISE.match(s.strip()) and not (0 < len(s.strip()) <= 2 and not re.search("[가-힣a-zA-Z0-9]", s)))
    return "\n".join(re.sub(r"^#{7,}\s+", "", s) for s in solid).strip()


def parts_of(body: str, text_max: int = TEXT_MAX, table_max: int = TABLE_MAX, least: int = LEAST) -> list[tuple[str, str]]:
    """(kind, content) of a clean text: tables by rows, all else by paragraphs."""
    out = []
    for table, run in blocks(body.split("\n")):
        content = "\n".join(run).strip()
        if content and table:
            out += [("table", part) for part in table_rows(content, table_max)]
        elif content:
            out += [("text", part) for part in ([content] if len(content) <= text_max else paragraphs(content, text_max, least))]
    return out


def page_spans(parts: list[str], raw: str, page: int | None) -> list[tuple[int | None, int | None]]:
    """First and last page of each part of a node's text that begins on a page: marks count that lie before the same share of the raw as of the clean text.

    A part that is not found (a table under a repeated head) has the span of the node.
    """
    marks, at = [], 0
    for line in raw.split("\n"):
        if m := re.match(tx.PAGE_MARKER, line):
            marks.append((at, int(m[1])))
        at += len(line) + 1
    if not marks:
        return [(page, page)] * len(parts)
    numbers = [p for _, p in marks]
    whole = (min(numbers) if page is None else min(page, *numbers), max(numbers))
    full = clean(raw)
    on = lambda place: next((p for a, p in reversed(marks) if a <= int(place / len(full) * len(raw))), page)
    out, after = [], 0
    for part in parts:
        begin = full.find(part.strip(), after)
        if begin < 0:
            out.append(whole)
            continue
        after = begin + len(part.strip())
        first, last = on(begin), on(after)
        both = [p for p in (first, last) if p]
        out.append((min(first, last), max(first, last)) if None not in (first, last) else (both[0], both[0]) if both else (None, None))
    return out


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """Chunks of markdown texts (doc, text) along their tree of headings: doc, node, part, heading, path, kind, part_index, part_total, first_page, last_page, content.

    Texts are normalised and their headings repaired; every heading is a node with the lines up to the next, under the path of the open
    headings. What comes before the first is one chunk (preamble), and a text without headings is one as a whole (no heading): these two
    have no kind, path or parts. Nodes of a table of contents are left out, not those below them; nodes without text have no chunk. A
    null text has none. A node's text is held in one task, a document's is not: nodes are windows and groups over lines.
    """
    fixed = F.flatten(F.transform(F.split(tx.normalize(F.col("text")), "\n"), tx.repaired_line))
    again = F.split(F.array_join(fixed, "\n"), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]")
    lines = structure.running_page(structure.heading_paths(docs.filter(F.col("text").isNotNull()).select("doc", F.posexplode(again).alias("pos", "line"))))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("node", F.sum(F.col("level").isNotNull().cast("int")).over(order))
    first = lambda c: F.max(F.when(F.col("level").isNotNull(), F.col(c))).alias(c)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: F.concat(x.line, F.lit("\n"))), "")
    nodes = lines.groupBy("doc", "node").agg(first("title"), first("path"), first("page"), body.alias("raw"))
    nodes = nodes.withColumn("headings", F.max("node").over(Window.partitionBy("doc"))).filter(~F.coalesce(tx.is_toc_heading(F.col("title")), F.lit(False)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, node, title, path, page, raw, headings in frame.itertuples(index=False):
                page, content = None if pd.isna(page) else int(page), clean(raw)
                if not headings:
                    rows.append((doc, 0, 0, "(no heading)", None, None, None, None, None, None, content or raw.strip()))
                elif not node and content:
                    own = [int(m[1]) for line in raw.split("\n") if (m := re.match(tx.PAGE_MARKER, line))]
                    rows.append((doc, 0, 0, "(preamble)", None, None, None, None, min(own, default=None), max(own, default=None), content))
                elif node and content:
                    parts = parts_of(content)
                    spans = page_spans([c for _, c in parts], raw, page)
                    rows += [(doc, node, i, title, path, kind, i, len(parts), *span, c.strip()) for i, ((kind, c), span) in enumerate(zip(parts, spans), 1)]
            out = pd.DataFrame(rows, columns=["doc", "node", "part", "heading", "path", "kind", "part_index", "part_total", "first_page", "last_page", "content"])
            yield out.astype({c: "Int32" for c in ("part_index", "part_total", "first_page", "last_page")})

    doc = docs.schema["doc"].dataType.simpleString()
    columns = nodes.select("doc", "node", "title", "path", "page", "raw", "headings")
    return columns.mapInPandas(run, f"doc {doc}, node bigint, part int, heading string, path string, kind string, part_index int, part_total int, first_page int, last_page int, content string")
