"""Structure of documents given as lines: headings, tables, clauses, annexes, columns; in windows over (doc, pos)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import facts, text

# Marks of clauses, annexes, quotations of other laws, and tables of payouts.
CLAUSE = r"^[#\s\-•*]*제\s*(\d+)\s*조\s*(?:【\s*([^】]+?)\s*】|\(\s*((?:[^()\n]|\([^()\n]*\))*?)\s*\))"
ANNEX = r"^[#\-•*\s]*[（(【]\s*별표\s*(\d+)\s*[)）】]\s*(.*)$"
LEADERS = r"[.·․…]{3,}"
OTHER_LAW = r"(의료법시행규칙|동법시행규칙|의료법|동법|상법|민법|보험업법|근로기준법|약관의?\s*규제[^\s]*)\s*제\s*\d+\s*조"
ICD = r"[A-Z]\d{2}(?:\.\d)?(?:\s*[~\-]\s*[A-Z]\d{2}(?:\.\d)?)?"
COLUMN_GAP = 60


def _order():
    return Window.partitionBy("doc").orderBy("pos")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def heading_paths(lines: DataFrame) -> DataFrame:
    """Adds level, title and path: the titles of the open headings, outermost first, without those of tables of contents.

    A heading of a level is open until one of the same or an outer level comes, so it counts if its position is
    after the last heading of any outer level.
    """
    level, title = text.heading(F.col("line"))
    out, last = _heads(lines.withColumns({"level": level, "title": title}))
    return out.select("*", *last).withColumn("path", _open_path()).drop("shown", *[f"h{i}" for i in range(1, 7)])


def _heads(lines: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Lines with what a heading (level, title) shows in paths, a column looked at once for a heading, and the last heading of each level up to a line."""
    shown = F.when(F.col("level").isNotNull() & ~text.is_toc_heading(F.col("title")), F.col("title"))
    last = [F.last(F.when(F.col("level") == i, F.struct("pos", "shown")), ignorenulls=True).over(_before()).alias(f"h{i}") for i in range(1, 7)]
    return lines.withColumn("shown", shown), last


def _open_path() -> Column:
    """The path of the open headings, of the last heading of each level (pos, shown) in h1 to h6."""
    parts = []
    for i in range(1, 7):
        outer = [F.coalesce(F.col(f"h{j}.pos"), F.lit(-1)) for j in range(1, i)]
        open_now = F.col(f"h{i}.pos") > reduce(lambda a, b: F.greatest(a, b), outer, F.lit(-1))
        parts.append(F.when(open_now, F.col(f"h{i}.shown")))
    return F.array_join(F.array_compact(F.array(*parts)), " > ")


def running_page(lines: DataFrame) -> DataFrame:
    """Adds the number of the last page marker at or before each line."""
    return lines.withColumn("page", F.last(text.page_of(F.col("line")), ignorenulls=True).over(_before()))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds kind (table or text) and the number of its block."""
    marked = lines.withColumn("kind", F.when(text.is_table_line(F.col("line")), "table").otherwise("text"))
    change = F.coalesce((F.col("kind") != F.lag("kind").over(_order())).cast("int"), F.lit(0))
    return marked.withColumn("change", change).withColumn("segment", F.sum("change").over(_before()))


def segments(lines: DataFrame) -> DataFrame:
    """Blocks of table lines and of other lines in order: doc, segment, kind, first_pos, n, content."""
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return _numbered(lines).groupBy("doc", "segment", "kind").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), text.strip(content).alias("content")).filter("content <> ''")


def headed_lines(lines: DataFrame) -> DataFrame:
    """doc, pos, path, table, line: lines of each document in order, whether they are a table's, and the path of the open headings where a block begins, else null.

    A block is of table lines or of others, and a heading begins one too; its own line is null. All windows are over one order, so lines are
    sorted once, and those that are dealt out by document already are not shuffled.
    """
    line = F.col("line")
    marked = lines.select("doc", "pos", "line", F.when(line.contains("#") | line.contains("|"), F.btrim(line, F.lit(" \t\n\x0b\f\r"))).alias("marks"))
    level, table = F.nullif(F.length(F.regexp_extract("marks", text.HEADING, 1)), F.lit(0)), F.col("marks").startswith("|") & F.col("marks").endswith("|")
    marked = marked.select("doc", "pos", "line", "marks", level.alias("level"), F.coalesce(table, F.lit(False)).alias("table"))
    marked = marked.withColumn("title", F.when(F.col("level").isNotNull(), text.strip(F.regexp_extract("marks", text.HEADING, 2))))
    marked, last = _heads(marked)
    marked = marked.select("*", F.lag("table").over(_order()).alias("before"), *last)
    begins = F.col("level").isNotNull() | F.col("before").isNull() | (F.col("table") != F.col("before"))
    return marked.select("doc", "pos", F.when(begins, _open_path()).alias("path"), "table", F.when(F.col("level").isNull(), line).alias("line")).sortWithinPartitions("doc", "pos")


def junk_tables(lines: DataFrame) -> DataFrame:
    """Blocks of table lines that have a single column; a line knows its block from the window that numbers them."""
    inner = F.regexp_replace(text.strip(F.col("line")), r"^\|+|\|+$", "")
    single = inner.rlike(r"^[\s\-:]+$") | ~inner.contains("|")
    return _numbered(lines).filter("kind = 'table'").groupBy("doc", "segment").agg(F.min(single).alias("junk"))


def clauses(lines: DataFrame) -> DataFrame:
    """Clauses of each document: run (a new one where numbers start again), jo, title, first_pos, end_pos, body.

    Titles stand in brackets of either kind. References to other laws and entries of a table of contents,
    which end in leaders, are none. A body goes to the line before the next clause.
    """
    masked = F.regexp_replace("line", OTHER_LAW, "")
    found = lines.filter(masked.rlike(CLAUSE) & ~masked.rlike(LEADERS))
    jo = F.regexp_extract(masked, CLAUSE, 1).cast("int")
    title = F.coalesce(F.nullif(F.regexp_extract(masked, CLAUSE, 2), F.lit("")), F.regexp_extract(masked, CLAUSE, 3))
    starts = found.select("doc", "pos", jo.alias("jo"), text.dedup_title(title).alias("title"))
    again = F.coalesce((F.col("jo") <= F.lag("jo").over(_order())).cast("int"), F.lit(0))
    starts = starts.withColumn("again", again).withColumn("run", F.sum("again").over(_before())).withColumn("next", F.lead("pos").over(_order())).drop("again")
    # each line belongs to the last clause that starts at or before it
    owner = F.last(F.col("start"), ignorenulls=True).over(_before())
    owned = lines.join(starts.select("doc", "pos", F.col("pos").alias("start")), ["doc", "pos"], "left").withColumn("owner", owner).filter("owner is not null")
    bodies = owned.groupBy("doc", F.col("owner").alias("pos")).agg(text.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")).alias("body"))
    return starts.join(bodies, ["doc", "pos"]).select("doc", "run", "jo", "title", F.col("pos").alias("first_pos"), (F.col("next") - 1).alias("end_pos"), "body")


def clause_integrity(parsed: DataFrame) -> DataFrame:
    """clean, or what is wrong with each run: gaps, duplicates, blank titles, empty bodies."""
    one = parsed.groupBy("doc", "run").agg(F.sort_array(F.collect_list("jo")).alias("all"), F.max((F.col("title") == "").cast("int")).alias("blank"), F.max((F.length("body") == 0).cast("int")).alias("empty"), F.count("*").alias("n"))
    gaps = F.array_except(F.sequence(F.lit(1), F.array_max("all")), F.col("all"))
    issues = F.concat_ws(",", F.when(F.size(gaps) > 0, "gap"), F.when(F.size(F.array_distinct("all")) < F.size("all"), "dup"), F.when(F.col("blank") == 1, "blank"), F.when(F.col("empty") == 1, "empty"))
    return one.select("doc", "run", "n", F.coalesce(F.nullif(issues, F.lit("")), F.lit("clean")).alias("structure"))


def clause_refs(parsed: DataFrame) -> DataFrame:
    """Edges doc, run, jo, ref_type, target, resolved: clauses and annexes that a body names, itself and other laws aside."""
    masked = F.regexp_replace("body", OTHER_LAW, "")
    articles = F.transform(F.regexp_extract_all(masked, F.lit(r"제\s*(\d+)\s*조"), F.lit(1)), lambda x: F.struct(F.lit("조항").alias("ref_type"), x.cast("int").alias("target")))
    annexes = F.transform(F.regexp_extract_all(masked, F.lit(r"별표\s*(\d+)"), F.lit(1)), lambda x: F.struct(F.lit("별표").alias("ref_type"), x.cast("int").alias("target")))
    edges = parsed.select("doc", "run", "jo", F.explode(F.array_distinct(F.concat(articles, annexes))).alias("r")).select("doc", "run", "jo", "r.*").filter((F.col("ref_type") != "조항") | (F.col("target") != F.col("jo")))
    known = parsed.select("doc", "run", F.col("jo").alias("target"), F.lit("조항").alias("ref_type"), F.lit(True).alias("known")).distinct()
    return edges.join(known, ["doc", "run", "target", "ref_type"], "left").select("doc", "run", "jo", "ref_type", "target", F.coalesce("known", F.lit(False)).alias("resolved"))


def annex_rows(lines: DataFrame) -> DataFrame:
    """Rows of classification annexes: doc, no, kind, section carried forward, codes."""
    s = text.strip(F.col("line"))
    head = F.when(F.col("line").rlike(ANNEX) & ~F.col("line").rlike(LEADERS), F.struct(F.regexp_extract("line", ANNEX, 1).cast("int").alias("no"), F.regexp_extract("line", ANNEX, 2).alias("title")))
    section = F.when(s.contains("보장대상이 되는"), "보장").when(s.contains("지급하지 않는") | s.contains("제외하여"), "미보장")
    out = lines.withColumn("a", F.last(head, ignorenulls=True).over(_before())).filter("a is not null")
    kind = F.when(F.col("a.title").contains("분류표"), "classification").when(F.col("a.title").contains("이율") | F.col("a.title").contains("계산"), "formula").otherwise("payout")
    inside = Window.partitionBy("doc", "a.no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"kind": kind, "section": F.last(section, ignorenulls=True).over(inside), "codes": F.transform(F.regexp_extract_all("line", F.lit(ICD), F.lit(0)), lambda c: F.regexp_replace(c, " ", ""))})
    return out.filter((F.size("codes") > 0) & (F.col("kind") == "classification")).select("doc", F.col("a.no").alias("no"), "kind", "pos", "section", "codes")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text.strip(line), r"^\|+|\|+$", ""), r"\|"), text.strip)


def payout_rows(lines: DataFrame) -> DataFrame:
    """Rules of three-column payout tables: coverage, rate, unit, limit, reduction."""
    rows = lines.filter(text.strip(F.col("line")).startswith("|")).withColumn("c", _cells(F.col("line"))).filter(F.size("c") == 3)
    first, amount = F.get("c", F.lit(0)), F.regexp_replace(F.get("c", F.lit(2)), "<br>", " ")
    rows = rows.filter((first != "") & ~first.contains("---") & ~first.rlike(r"^[\d ]+$") & ~first.rlike("급부명|구분|담보명|대상") & amount.contains("가입금액"))
    both = F.concat_ws(" ", F.get("c", F.lit(1)), amount)
    whole = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    period = whole(amount, r"([0-9]+)\s*년이?\s*지난.*전일\s*이전")
    return rows.select(
        "doc", "pos", text.strip(F.regexp_replace(F.regexp_replace(first, "<br>", " "), r"\s+", " ")).alias("coverage"), F.nullif(F.regexp_extract(amount, r"가입금액의?\s*([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).cast("decimal(10,2)").alias("rate_pct"),
        F.nullif(F.regexp_extract(amount, r"(1일당|1회당|매월|매년|일당|회당)", 1), F.lit("")).alias("per_unit"), whole(both, r"([0-9]+)\s*일\s*한도").alias("limit_days"), whole(amount, r"상기\s*금액의?\s*([0-9]+)\s*%").alias("reduction_rate_pct"),
        F.concat(period.cast("string"), F.lit("년이내")).alias("reduction_period"), F.when(amount.rlike(r"재해\s*(?:이\s*외|는?\s*제외|를\s*제외)"), "재해외").alias("reduction_cause"),
    )


def payout_matrix(lines: DataFrame) -> DataFrame:
    """Rules of tables with a column for each elapsed period; the cause is the last one named before. A row with one filled cell has no period."""
    named = F.regexp_extract("line", r"(상해|재해|질병)\s*[을를]?\s*원인", 1)
    cause = F.when(named.isin("상해", "재해"), "상해").when(named == "질병", "질병")
    table = text.strip(F.col("line")).startswith("|")
    head = table & F.col("line").rlike(r"90\s*일\s*(이하|초과)")
    marked = lines.withColumns({"table": table, "cause": F.last(cause, ignorenulls=True).over(_before()), "head": F.when(head, F.struct("pos", _cells(F.col("line")).alias("cells"))), "gap": F.when(~table, F.col("pos"))})
    marked = marked.withColumns({"own": F.last("head", ignorenulls=True).over(_before()), "gap": F.last("gap", ignorenulls=True).over(_before())})
    body = marked.filter(F.col("table") & F.col("head").isNull() & (F.col("own.pos") > F.coalesce("gap", F.lit(-1)))).withColumn("c", _cells(F.col("line")))

    def bucket(h: Column) -> Column:
        h = F.regexp_replace(h, " ", "")
        return F.when(h.contains("90일") & h.contains("이하"), "90일이하").when(h.contains("초과") & h.contains("미만"), "90일초과1년미만").when(h.contains("1년") & h.contains("이상"), "1년이상")

    cells = body.select("doc", "pos", "cause", text.strip(F.regexp_replace(F.get("c", F.lit(0)), "<br>", " ")).alias("coverage"), F.posexplode(F.transform(F.arrays_zip(F.col("own.cells").alias("h"), F.col("c").alias("v")), lambda x: F.struct(bucket(x.h).alias("bucket"), F.nullif(F.regexp_extract(x.v, r"가입금액의?\s*([0-9]+)\s*%", 1), F.lit("")).cast("int").alias("rate")))).alias("i", "x"))
    cells = cells.filter(F.col("x.bucket").isNotNull() & F.col("x.rate").isNotNull() & (F.col("coverage") != "") & ~F.col("coverage").contains("---"))
    filled = F.count("*").over(Window.partitionBy("doc", "pos"))
    return cells.select("doc", "pos", "coverage", "cause", F.when(filled > 1, F.col("x.bucket")).alias("period_bucket"), F.col("x.rate").alias("rate_pct"))


def contract_terms(docs: DataFrame) -> DataFrame:
    """Cooling-off, renewal, cycle and term as the text (doc, text) states them."""
    whole = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).cast("int")
    cooling = F.coalesce(whole(r"철회[^\n]{0,50}?(\d+)\s*일\s*이내"), whole(r"(\d+)\s*일\s*이내[^\n]{0,30}?철회"))
    return docs.select("doc", cooling.alias("cooling_off_days"), F.col("text").rlike(r"갱신\s*형|자동\s*갱신|\d+\s*년\s*마다\s*갱신").alias("is_renewable"), whole(r"(\d+)\s*년\s*마다\s*갱신").alias("renewal_cycle_years"), whole(r"(\d+)\s*년\s*만기").alias("term_years"))


def reading_order(nodes: DataFrame) -> DataFrame:
    """Place of each layout node (doc, page, id, x0, y1): by page, column from the left, and from the top.

    A column begins where left edges, in order, leave a gap of more than COLUMN_GAP.
    """
    across = Window.partitionBy("doc", "page").orderBy("x0", "id")
    gap = F.coalesce((F.col("x0") - F.lag("x0").over(across) > COLUMN_GAP).cast("int"), F.lit(0))
    columns = nodes.withColumn("gap", gap).withColumn("column", F.sum("gap").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    place = Window.partitionBy("doc").orderBy("page", "column", F.desc("y1"), "id")
    return columns.withColumn("place", F.row_number().over(place)).drop("gap")


def merge_recognised(chunks: DataFrame, recognised: DataFrame) -> DataFrame:
    """Chunks of text (doc, seq, heading_path, start_page) with recognised ones put in, numbered anew.

    One with a heading goes behind the last chunk of that heading, else behind all; one without goes before the
    first chunk of a later page.
    """
    last = chunks.groupBy("doc", "heading_path").agg(F.max("seq").alias("after"))
    ends = chunks.groupBy("doc").agg(F.max("seq").alias("end"))
    with_heading = recognised.filter(F.col("heading_path").isNotNull()).join(last, ["doc", "heading_path"], "left").join(ends, "doc").select(*recognised.columns, (F.coalesce("after", "end") + 0.5).alias("at"))
    # the first chunk of a later page is one whose page is higher than all before it; of these the pages rise
    seen = F.max("page").over(Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    steps = chunks.select("doc", "seq", F.coalesce("start_page", F.lit(0)).alias("page")).withColumn("seen", seen).filter(F.col("page") > F.coalesce("seen", F.lit(-1)))
    rest = recognised.filter(F.col("heading_path").isNull()).select("doc", F.struct(*recognised.columns).alias("id"), (-F.coalesce("start_page", F.lit(0)) - 0.5).alias("at"))
    first = nearest_before(rest, steps.select("doc", (-F.col("page")).cast("double").alias("at"), F.col("seq").alias("value")))
    without = first.join(ends, "doc").select(*[F.col("id")[c].alias(c) for c in recognised.columns], F.coalesce(F.col("value") - 0.5, F.col("end") + 0.5).alias("at"))
    rows = chunks.withColumns({"at": F.col("seq").cast("double"), "recognised": F.lit(False)}).unionByName(with_heading.unionByName(without).withColumns({"at": F.col("at").cast("double"), "recognised": F.lit(True)}).withColumnRenamed("id", "seq"))
    order = Window.partitionBy("doc").orderBy("at", "recognised", "seq")
    return rows.withColumn("new_seq", F.row_number().over(order)).select("doc", "seq", "recognised", "new_seq")


def nearest_before(points: DataFrame, marks: DataFrame) -> DataFrame:
    """As-of join by position: each point (doc, id, at) with the last mark (doc, at, value) at or before it; one sort of both."""
    both = points.select("doc", "id", "at", F.lit(None).cast(marks.schema["value"].dataType).alias("value"), F.lit(1).alias("point")).unionByName(marks.select("doc", F.lit(None).cast(points.schema["id"].dataType).alias("id"), "at", "value", F.lit(0).alias("point")))
    seen = F.last("value", ignorenulls=True).over(Window.partitionBy("doc").orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("value", seen).filter("point = 1").select("doc", "id", "at", "value")


def numeric_claims(lines: DataFrame) -> DataFrame:
    return lines.select("doc", "pos", F.explode(facts.numeric_facts(F.col("line"))).alias("fact")).select("doc", "pos", "fact.*")


def exclusion_map(parsed: DataFrame) -> DataFrame:
    """Clauses that exclude (by title) or reduce (by body, titles of definitions aside): doc, run, coverage_jo, jo, kind."""
    general = F.col("title").rlike("지급하지 않는|지급하지 아니|보상하지 않는|면책|부담보|보장하지 않는|지급하지않는")
    reduction = ~F.col("title").rlike("정의|준용|목적") & F.col("body").rlike(r"(?:보험금|급여금)\s*의?\s*\d+\s*%\s*(?:만\s*)?(?:을|를)?\s*지급|감액하여?\s*지급")
    kind = F.when(general, "general").when(reduction, "reduction")
    first = F.min(F.when(F.col("title").contains("지급사유"), F.col("jo"))).over(Window.partitionBy("doc", "run"))
    return parsed.select("doc", "run", first.alias("coverage_jo"), "jo", kind.alias("kind")).filter("kind is not null")


def exclusion_reasons(parsed: DataFrame) -> DataFrame:
    """Standard reasons of all excluding clauses of a document."""
    from tessera.functions import routing

    own = parsed.filter(F.col("title").rlike("지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책"))
    return own.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(routing.exclusion_tags(F.col("body")))))).alias("reasons"))


def coverage_ranges(lines: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """doc, pos, coverage, code_token of two-column tables whose first cell names a disease."""
    from tessera.functions import routing

    rows = lines.filter(text.strip(F.col("line")).startswith("|")).withColumn("c", _cells(F.col("line"))).filter(F.size("c") == 2)
    tokens = F.regexp_extract_all(F.get("c", F.lit(1)), F.lit(r"[CD]\d{2}(?:\.\d)?(?:\s*[~\-]\s*[CD]\d{2}(?:\.\d)?)?"), F.lit(0))
    return rows.select("doc", "pos", routing.first_match(F.get("c", F.lit(0)), names).alias("coverage"), F.explode(tokens).alias("code_token")).filter("coverage is not null")


def heading_levels(lines: DataFrame) -> DataFrame:
    level, _ = text.heading(F.col("line"))
    return lines.groupBy(level.alias("level")).agg(F.count("*").alias("n")).filter("level is not null")


def sections(lines: DataFrame, ends_with: str = "특별약관") -> DataFrame:
    """Sub-contracts under headings that end in a word: doc, name, first_pos, end_pos (null: to the end)."""
    level, title = text.heading(F.col("line"))
    found = lines.select("doc", "pos", title.alias("name"), level.alias("level")).filter(F.col("name").endswith(ends_with))
    return found.select("doc", "name", F.col("pos").alias("first_pos"), (F.lead("pos").over(_order()) - 1).alias("end_pos"))
