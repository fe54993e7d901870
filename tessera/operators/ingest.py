"""From documents to tables: staged texts, contracts and their riders, annexes, products, and all rows of a load at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, quality, state, structure

# Names by which texts call companies, and their full names.
COMPANIES = [
    ("라이나생명", "라이나생명"), ("라이나", "라이나생명"), ("삼성생명", "삼성생명"), ("한화생명", "한화생명"), ("교보생명", "교보생명"), ("KB손해보험", "KB손해보험"), ("KB손보", "KB손해보험"), ("KB", "KB손해보험"),
    ("현대해상", "현대해상"), ("DB손해보험", "DB손해보험"), ("메리츠", "메리츠화재"), ("AXA손해보험", "AXA손해보험"), ("삼성화재", "삼성화재"), ("흥국화재", "흥국화재"),
]


def _order():
    return Window.partitionBy("doc").orderBy("pos")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def joined(lines: DataFrame) -> DataFrame:
    """doc, text: the lines of each document in order. A document's own lines are all that one row holds."""
    return lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))


def without_contents(lines: DataFrame) -> DataFrame:
    """Lines outside sections of a table of contents: from its heading to before the next heading of the same or an outer level.

    A heading is a contents heading if it comes outside such a section; as an inner heading cannot end the
    section of an outer one, a line is inside if the last contents heading comes after the last heading of its level or an outer one.
    """
    level, title = text.heading(F.col("line"))
    toc = level.isNotNull() & title.rlike(text.TOC_TITLE)
    own = lines.withColumns({"level": level, "toc": toc})
    # the last contents heading and the last other heading of each level or an outer one
    marks = [F.max(F.when(F.col("toc") & (F.col("level") == i), F.col("pos"))).over(_before()).alias(f"t{i}") for i in range(1, 7)]
    ends = [F.max(F.when(F.col("level").isNotNull() & ~F.col("toc") & (F.col("level") <= i), F.col("pos"))).over(_before()).alias(f"e{i}") for i in range(1, 7)]
    own = own.select("*", *marks, *ends)
    inside = F.lit(False)
    for i in range(1, 7):
        inside = inside | (F.col(f"t{i}").isNotNull() & (F.col(f"t{i}") > F.coalesce(F.col(f"e{i}"), F.lit(-1))))
    return own.filter(~inside).select(*lines.columns)


def first_contract(parsed: DataFrame) -> DataFrame:
    """Clauses up to where numbers begin anew."""
    return parsed.filter("run = 0")


def annexes(lines: DataFrame) -> DataFrame:
    """Annexes of each document: no, title, kind, first_pos, end_pos, body; a body goes to the line before the next annex, the first of one number stays."""
    head = F.col("line").rlike(structure.ANNEX) & ~F.col("line").rlike(structure.LEADERS)
    title = text.dedup_title(F.regexp_extract("line", structure.ANNEX, 2))
    kind = F.when(title.contains("분류표"), "classification").when(title.contains("이율") | title.contains("계산"), "formula").otherwise("payout")
    starts = lines.filter(head).select("doc", "pos", F.regexp_extract("line", structure.ANNEX, 1).cast("int").alias("no"), title.alias("title"), kind.alias("kind")).withColumn("next", F.lead("pos").over(_order()))
    owner = F.last(F.when(head, F.col("pos")), ignorenulls=True).over(_before())
    bodies = lines.withColumn("owner", owner).filter("owner is not null").groupBy("doc", F.col("owner").alias("pos")).agg(text.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")).alias("body"))
    rows = starts.join(bodies, ["doc", "pos"]).select("doc", "no", "title", "kind", F.col("pos").alias("first_pos"), (F.col("next") - 1).alias("end_pos"), "body")
    return quality.lowest(rows, ["doc", "no"], ["first_pos"], 1).drop("rank")


def contracts(lines: DataFrame, parsed: DataFrame, reach: int = 400) -> DataFrame:
    """Contracts of each document, one for each run of clause numbers: run, first_jo, last_jo, n, first_pos, heading.

    The heading is the last one within so many characters before the run that names general or special terms; else the last line that does.
    """
    runs = parsed.groupBy("doc", "run").agg(F.min("first_pos").alias("first_pos"), F.min_by("jo", "first_pos").alias("first_jo"), F.max_by("jo", "first_pos").alias("last_jo"), F.count("*").alias("n"))
    clean = F.regexp_replace("line", r"^[ #\-•*\t]+|[ #\-•*\t]+$", "")
    heading = text.strip(F.col("line")).startswith("#") & F.col("line").rlike("특별약관|보통약관")
    plain = F.col("line").contains("특별약관") | clean.startswith("보통약관")
    size = F.sum(F.length("line") + 1).over(_before())
    own = lines.select("doc", "pos", (size - F.length("line") - 1).alias("begin"), size.alias("end"), F.when(heading, clean).alias("head"), F.when(plain, clean).alias("line"))
    # the last of each kind before a line; if it is too far away, so are all before it
    last = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct("end", F.col(c).alias("text"))), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    near = own.withColumns({"h": last("head"), "l": last("line")}).join(runs.select("doc", "run", F.col("first_pos").alias("pos")), ["doc", "pos"])
    within = lambda c: F.when(F.col(f"{c}.end") > F.col("begin") - reach, F.col(f"{c}.text"))
    near = near.select("doc", "run", within("h").alias("head"), within("l").alias("plain"))
    return runs.join(near, ["doc", "run"], "left").select("doc", "run", "first_jo", "last_jo", "n", "first_pos", F.coalesce("head", "plain", F.lit("")).alias("heading"))


def load_sections(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Sections that a load makes products of: doc, name (null: the main contract), child, first_pos.

    Documents with two titled sections or more use those; else each run of clause numbers, of which all but
    the first must have a heading that ends in the word for riders; a document with one run is one section.
    """
    titled = structure.sections(lines)
    many = titled.groupBy("doc").agg(F.count("*").alias("sections"))
    runs = contracts(lines, parsed).join(many, "doc", "left")
    by_run = runs.filter(F.coalesce("sections", F.lit(0)) < 2).filter((F.col("run") == 0) | F.col("heading").endswith("특별약관"))
    own = by_run.select("doc", F.when(F.col("run") > 0, F.col("heading")).alias("name"), (F.col("run") > 0).alias("child"), "first_pos")
    main = runs.filter("sections >= 2 and run = 0").select("doc", F.lit(None).cast("string").alias("name"), F.lit(False).alias("child"), "first_pos")
    return own.union(main).union(titled.join(many.filter("sections >= 2"), "doc").select("doc", "name", F.lit(True).alias("child"), "first_pos"))


def titled_contracts(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Riders under numbered titles: doc, name, first_pos, n; one counts if it has two clauses or more, one of them on what else applies."""
    title = text.rider_title(F.col("line"))
    owner = F.last(F.when(title.isNotNull(), F.struct(F.col("pos").alias("first_pos"), title.alias("name"))), ignorenulls=True).over(_before())
    own = lines.select("doc", "pos", owner.alias("o")).filter("o is not null")
    rows = parsed.select("doc", F.col("first_pos").alias("pos"), "title").join(own, ["doc", "pos"])
    return rows.groupBy("doc", "o.name", "o.first_pos").agg(F.count("*").alias("n"), F.max(F.col("title").contains("준용").cast("int")).alias("refers")).filter("n >= 2 and refers = 1").select("doc", "name", "first_pos", "n")


def company(content: Column) -> Column:
    """Full name of the company that a text names, by the longest of its short names."""
    found = None
    for short, full in sorted(COMPANIES, key=lambda c: -len(c[0])):
        found = F.when(content.contains(short), full) if found is None else found.when(content.contains(short), full)
    return found


def products(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row for each document (doc, text): name, company, kind, renewable, coverage_name, payout_condition, payout_annex, resolution_note; what the text does not say is null."""
    titles = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}\s*(.+?(?:특약|보험)[^\n#]*)$"), F.lit(1))
    name = text.strip(F.get(F.filter(titles, lambda t: ~t.rlike("목차|안내|요약|유의사항|해설")), F.lit(0)))
    grant = parsed.filter(F.col("title").contains("지급사유")).groupBy("doc").agg(F.min_by("body", F.struct("run", "jo")).alias("grant"))
    defers = parsed.filter(F.col("title").contains("준용")).groupBy("doc").agg(F.min(F.struct("run", "jo")).alias("defers"))
    part = lambda p: F.nullif(F.regexp_extract("grant", p, 1), F.lit(""))
    condition = F.substring(F.regexp_replace(text.strip(part(r"회사는\s*(.+?)(?:때에는|경우에는)")), r"\s+", " "), 1, 150)
    note = F.when(F.col("defers").isNotNull(), F.concat(F.lit("청약철회·대기기간 등 미기재 필드는 주계약 준용(제"), F.col("defers.jo").cast("string"), F.lit("조) 소관. 주계약 문서 미확보 → 해당 질의는 '답변 불가'가 정답.")))
    rows = docs.withColumn("name", name).join(grant, "doc", "left").join(defers, "doc", "left")
    return rows.select(
        "doc", "name", company(F.col("text")).alias("company"), F.when(F.coalesce(F.col("name").contains("특약"), F.lit(False)), "특약").otherwise("주계약").alias("kind"), (F.col("text").contains("갱신형") | F.col("text").contains("특약의 갱신")).alias("is_renewable"),
        text.strip(part(r"보험수익자에게\s*([^(（]+?)\s*[(（]\s*별표")).alias("coverage_name"), condition.alias("payout_condition"), part(r"별표\s*(\d+)").cast("int").alias("payout_annex"), note.alias("resolution_note"),
    )


SUBITEMS = "array<struct<hang: int, text: string, hos: array<struct<ho: int, text: string, moks: array<struct<mok: string, text: string>>>>, moks: array<struct<mok: string, text: string>>>>"


def _subitems(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: chunking.subitems(b or ""))


def with_subitems(parsed: DataFrame) -> DataFrame:
    """Clauses with the tree of their paragraphs, items and sub-items, and how many of each there are; a paragraph without number is not counted."""
    own = parsed.withColumn("hangs", F.pandas_udf(_subitems, SUBITEMS)("body"))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    inner = F.transform("hangs", lambda h: total(F.transform(h.hos, lambda o: F.size(o.moks))))
    return own.withColumns({"n_hang": F.size(F.filter("hangs", lambda h: h.hang > 0)), "n_ho": total(F.transform("hangs", lambda h: F.size(h.hos))), "n_mok": total(F.transform("hangs", lambda h: F.size(h.moks))) + total(inner)})


def general_exclusions(exclusions: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc, run, jo, title of the clauses that exclude in general, each once: exclusions (doc, run, jo, kind) with clauses."""
    own = exclusions.filter("kind = 'general'").select("doc", "run", "jo").distinct()
    return own.join(parsed.select("doc", "run", "jo", "title"), ["doc", "run", "jo"]).distinct()


def index_rows(parsed: DataFrame, annex: DataFrame, product: DataFrame, wanted: list | None = None) -> DataFrame:
    """What an index loads: clauses and annexes of the wanted products (all, if None) with the product's name: doc, product_name, kind, ref, content."""
    chosen = product if wanted is None else product.filter(F.col("doc").isin(wanted))
    own = chosen.select("doc", F.col("name").alias("product_name"))
    clause = parsed.select("doc", F.lit("clause").alias("kind"), F.concat(F.lit("S"), F.col("run").cast("string"), F.lit("_제"), F.col("jo").cast("string"), F.lit("조")).alias("ref"), text.with_heading(F.col("title"), F.col("body")).alias("content"))
    other = annex.select("doc", F.lit("annex").alias("kind"), F.concat(F.lit("별표"), F.col("no").cast("string")).alias("ref"), text.with_heading(F.col("title"), F.col("body")).alias("content"))
    return clause.unionByName(other).join(own, "doc").select("doc", "product_name", "kind", "ref", "content")


def clean_text(content: Column) -> Column:
    """The least that staging changes: no byte-order mark, no blanks at ends of lines, one empty line at most."""
    content = F.replace(content, F.lit("﻿"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(content, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def stage(docs: DataFrame) -> dict[str, DataFrame]:
    """Raw documents (doc, text) as staged tables: clean (doc, text), clauses of the first contract, profile."""
    clean = docs.select("doc", clean_text(F.col("text")).alias("text"))
    lines = clean.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return {"clean": clean, "clauses": first_contract(structure.clauses(lines)).select("doc", "jo", "title", "body"), "profile": quality.format_profile(clean)}


def load(lines: DataFrame, llm: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of a load from lines (doc, pos, line): product, section, clause, clause_ref, annex, annex_row, exclusion, payout, gate.

    llm: rules that a model adds to those of the tables, as a function of lines; its rows are tagged so.
    """
    parsed, docs, annex = structure.clauses(lines), joined(lines), annexes(lines)
    rules = structure.payout_rows(lines).withColumn("source", F.lit("rule"))
    if llm is not None:
        rules = with_model_rules(rules, llm(lines))
    return {
        "product": products(docs, parsed), "section": load_sections(lines, parsed), "clause": with_subitems(parsed), "clause_ref": structure.clause_refs(parsed), "annex": annex, "annex_row": structure.annex_rows(lines),
        "exclusion": structure.exclusion_map(parsed), "payout": rules, "gate": quality.document_gate(docs, parsed, annex),
    }


def with_model_rules(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rules of both sources, each tagged; columns that one lacks are null."""
    return rules.unionByName(found.withColumn("source", F.lit("llm")), allowMissingColumns=True)


def register(documents: DataFrame, first: str = "00") -> tuple[DataFrame, DataFrame]:
    """Log and snapshot rows of new documents (document_id, event_id, ts): both begin with the first status."""
    log = documents.select("document_id", "event_id", F.lit(first).alias("to_status"), "ts")
    return log, state.snapshot(log)


def offsets(lines: DataFrame) -> DataFrame:
    """Adds the character at which each line begins, in the joined text."""
    return lines.withColumn("at", F.sum(F.length("line") + 1).over(_before()) - F.length("line") - 1)


def chunk_pages(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, seq, start_page, end_page of chunks (doc, seq, content) of a document given as lines: the share of characters before and up to a chunk's end is mapped to the lines, and the last page mark there counts; null before the first."""
    own = offsets(lines)
    marks = own.select("doc", "at", text.page_of(F.col("line")).alias("value")).filter("value is not null")
    raw = own.groupBy("doc").agg(F.max(F.col("at") + F.length("line")).alias("raw"))
    w = Window.partitionBy("doc")
    end = F.sum(F.length("content")).over(w.orderBy("seq"))
    edges = chunks.select("doc", "seq", (end - F.length("content")).alias("a"), end.alias("b"), F.greatest(F.sum(F.length("content")).over(w), F.lit(1)).alias("total")).join(raw, "doc")
    points = edges.select("doc", "seq", "raw", "total", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("n")), F.struct(F.lit(1).alias("side"), F.col("b").alias("n")))).alias("e"))
    points = points.select("doc", (F.col("seq") * 2 + F.col("e.side")).alias("id"), F.floor(F.col("e.n") / F.col("total") * F.col("raw")).alias("at"))
    found = structure.nearest_before(points, marks.withColumn("at", F.col("at").cast("bigint")))
    return found.groupBy("doc", F.floor(F.col("id") / 2).alias("seq")).agg(F.min("value").alias("start_page"), F.max("value").alias("end_page"))
