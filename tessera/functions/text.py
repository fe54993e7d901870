"""Normalising, cleaning and measuring texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAGE_MARKER = r"^<!-- page:(\d+) -->"
HEADING = r"^(#{1,6})\s+(.+)$"
TOC_TITLE = r"(?i)^(목\s*차|차\s*례|table\s+of\s+contents|contents)$"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has none of its own."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# Blanks that are one or none, quotation marks and dashes, and what they become.
BLANKS, NOTHING = "\u00a0\u3000", "\u200b\u200c\u200d\ufeff"
DOUBLE_QUOTES, SINGLE_QUOTES = "「」『』\u201c\u201d\u201e\u201f\u00ab\u00bb", "\u2018\u2019\u201a\u201b"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
REPLACED = BLANKS + DOUBLE_QUOTES + SINGLE_QUOTES + DASHES + NOTHING
REPLACEMENTS = " " * len(BLANKS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES)


def squeeze(text: Column) -> Column:
    """White space, quotes and dashes in one form: everything of the normaliser but the compatibility composition."""
    text = F.translate(text, REPLACED, REPLACEMENTS)
    text = F.regexp_replace(text, "\t", "    ")
    text = F.regexp_replace(text, "·{3,}", " ")
    text = F.regexp_replace(text, "…{2,}", " ")
    text = F.regexp_replace(text, "[ \t]+\n", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, " {2,}", " ")


def normalize(text: Column) -> Column:
    """squeeze() after compatibility composition, which only texts beyond ASCII need."""
    return squeeze(F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_noise_line(line: Column) -> Column:
    """Image tags, dot leaders, page numbers, and one or two signs alone."""
    s = strip(line)
    patterns = [r"^!\[image\s+\d+\]", "·{5}", "…{3}", r"^[-–—]\s*\d+\s*[-–—]$", r"^\d+\s*[-–—]$", r"(?i)^(page\s+)?\d+\s*/\s*\d+$", r"(?i)^page\s+\d+\s+of\s+\d+$"]
    noise = (F.length(s) <= 2) & ~s.rlike("[가-힣a-zA-Z0-9]")
    for p in patterns:
        noise = noise | s.rlike(p)
    return (s != "") & noise


def is_table_line(line: Column) -> Column:
    s = strip(line)
    return s.startswith("|") & s.endswith("|")


def page_of(line: Column) -> Column:
    """Number of a page marker, else null."""
    return F.nullif(F.regexp_extract(line, PAGE_MARKER, 1), F.lit("")).cast("int")


def page_range(text: Column) -> tuple[Column, Column]:
    pages = F.regexp_extract_all(text, F.lit("(?m)" + PAGE_MARKER), F.lit(1)).cast("array<int>")
    return F.array_min(pages), F.array_max(pages)


def heading(line: Column) -> tuple[Column, Column]:
    """Level and text of a markdown heading, else nulls."""
    s = strip(line)
    level = F.nullif(F.length(F.regexp_extract(s, HEADING, 1)), F.lit(0))
    return level, F.when(level.isNotNull(), strip(F.regexp_extract(s, HEADING, 2)))


def is_toc_heading(text: Column) -> Column:
    """A title of a table of contents, or an entry of one: leaders, or a page number with enough of them."""
    s = strip(text)
    leaders = (F.regexp_count(s, F.lit("·")) >= 3) | (F.regexp_count(s, F.lit("…")) >= 2)
    return s.rlike(TOC_TITLE) | ((s.rlike("[·…]{3,}") | s.rlike(r"\s+\d+\s*$")) & leaders)


def scoring_form(text: Column, drop: str = r"[\s.,;:!?()\[\]{}'\"·\-]") -> Column:
    """The form in which texts are compared for scores: lower case, without white space and the given characters."""
    return F.lower(F.regexp_replace(text, drop, ""))


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def strip_media(text: Column) -> Column:
    """Image tags go, line-break tags become blanks."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), " {2,}", " ")


def grams(text: Column, n: int = 2) -> Column:
    """Distinct runs of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two-character runs."""
    return jaccard(grams(a), grams(b))


def dedup_title(title: Column) -> Column:
    """A title written twice with a blank between, once."""
    t = strip(F.regexp_replace(title, r"\s+", " "))
    half = F.floor(F.length(t) / 2).cast("int")
    twice = (F.length(t) % 2 == 1) & (F.substring(t, half + 1, F.lit(1)) == " ") & (F.substring(t, F.lit(1), half) == F.substring(t, half + 2, half))
    return F.when(twice, F.substring(t, F.lit(1), half)).otherwise(t)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def with_heading(path: Column, content: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(path, F.lit("\n\n"), content)).otherwise(content)


def ocr_verdict(text: Column) -> Column:
    """Why recognised text is of no use: empty, too_short, special_only, math_noise, low_lang_ratio; else passed."""
    s = strip(F.coalesce(text, F.lit("")))
    letters = F.regexp_count(s, F.lit("[가-힣a-zA-Z]"))
    solid = F.length(F.regexp_replace(s, r"\s", ""))
    return (
        F.when(s == "", "empty")
        .when(F.length(s) < 10, "too_short")
        .when(~s.rlike("[가-힣a-zA-Z0-9]"), "special_only")
        .when(s.rlike(r"^[\d\s+\-*/=().,^%<>]+$"), "math_noise")
        .when(letters / solid < 0.3, "low_lang_ratio")
        .otherwise("passed")
    )


def image_verdict(exists: Column, size: Column, width: Column, height: Column, stddev: Column) -> Column:
    """First filter that an image fails, else ok."""
    return (
        F.when(~exists, "not_exists")
        .when(size < 100, "file_size")
        .when((width < 10) | (height < 10), "too_small")
        .when((width < 400) | (height < 300), "below_min")
        .when(width / height >= 10, "too_wide")
        .when(height / width >= 10, "too_tall")
        .when((width > 7000) | (height > 7000), "too_large")
        .when((stddev > 0) & (stddev < 10), "flat")
        .otherwise("ok")
    )


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID of version 5, from a hash alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def safe_name(path: Column) -> Column:
    """Last part of a path; null if the path goes elsewhere, is absolute or has a part of dots."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    bad = path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"^[/\\]") | name.isin("", ".", "..")
    return F.when(~bad, name)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def natural_key(text: Column) -> Column:
    """Parts of digits and other characters, in which numbers sort by value."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d+$"), F.lit(0)).otherwise(1).alias("kind"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"), F.lower(p).alias("text")))


def mask_same_length(text: Column, pattern: str, filler: str = "␡") -> Column:
    """Matches replaced by a filler of the same length, so positions stay: built from the parts between matches."""
    rest = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.transform(rest, lambda part, i: F.concat(part, F.repeat(F.lit(filler), F.coalesce(F.length(F.get(found, i)), F.lit(0)))))
    return F.array_join(joined, "")


def sentence_parts(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=\.)\s+"), lambda s: s != "")


def render_nodes(nodes: Column) -> Column:
    """Markdown of ordered layout nodes (level, content): headings under as many signs as their level, six at most."""
    shown = F.transform(nodes, lambda n: F.when(n.level > 0, F.concat(F.repeat(F.lit("#"), F.least(n.level, F.lit(6))), F.lit(" "), n.content)).otherwise(n.content))
    return F.array_join(shown, "\n\n")


#: Titles of clauses as lists or plain lines give them; what follows round brackets must be blank, as references go on at once.
ARTICLE_TITLE = r"^\s*[-*]?\s*(제\s*\d+\s*조(?:\s*의\s*\d+)?\s*(?:【[^】]*】|\([^)]*\)(?=\s|$)))\s*(.*)$"


def repaired_line(line: Column) -> Column:
    """Lines (array) that a line of markdown becomes: none for leaders of a table of contents, a heading that ends as a sentence does becomes text, a clause's title becomes a heading of level five with what follows on a line of its own."""
    line = F.regexp_replace(F.regexp_replace(line, r"!\[[^\]]*\]\([^)]*\)", ""), r"(?i)<br\s*/?>", " ")
    s = strip(line)
    title = strip(F.regexp_extract(s, r"^#{1,6}\s+(.*)$", 1))
    fragment = title.rlike(r"(?:다|요|음|함|됨|임)\s*[.。]$") & ~title.rlike(r"제\s*\d+\s*[조관장절편]|별표|【")
    rest = strip(F.regexp_extract(s, ARTICLE_TITLE, 2))
    promoted = F.array_compact(F.array(F.concat(F.lit("##### "), strip(F.regexp_extract(s, ARTICLE_TITLE, 1))), F.nullif(rest, F.lit(""))))
    return (
        F.when(s.rlike(r"\.{4,}|·{5,}|…{3,}"), F.array().cast("array<string>"))
        .when(s.rlike(r"^#{1,6}\s+"), F.array(F.when(fragment, title).otherwise(line)))
        .when(s.rlike(ARTICLE_TITLE), promoted)
        .otherwise(F.array(line))
    )


def repair_headings(text: Column) -> Column:
    """A markdown text with repaired_line() for each of its lines."""
    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), repaired_line)), "\n")


def clean_coverage(name: Column) -> Column:
    """A coverage's name without break tags, white space in one form."""
    return strip(F.regexp_replace(F.replace(name, F.lit("<br>"), F.lit(" ")), r"\s+", " "))


def plain_coverage(name: Column) -> Column:
    """As clean_coverage, without what stands in brackets."""
    return clean_coverage(F.regexp_replace(name, r"\([^)]*\)", ""))


def converted_well(types: Column) -> Column:
    """Whether a converter's element types (array) have headings and no mere pieces of text."""
    return F.array_contains(types, "heading") & ~F.array_contains(types, "text chunk")


def page_count(text: Column) -> Column:
    """Page markers of a text, one at least."""
    return F.greatest(F.regexp_count(text, F.lit("(?m)" + PAGE_MARKER)), F.lit(1))


def pdf_pages(content: Column) -> Column:
    """The largest count of pages that a PDF's bytes state, 200 where they state none."""
    counts = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Count\s+(\d+)"), F.lit(1)).cast("array<int>")
    return F.coalesce(F.array_max(counts), F.lit(200))


def page_span(own: Column, marks: Column) -> tuple[Column, Column]:
    """First and last page of a section: the lesser of its heading's page and its first mark, and its last mark or else the heading's page."""
    return F.least(own, F.array_min(marks)), F.coalesce(F.array_max(marks), own)


def rider_title(line: Column) -> Column:
    """Title of a numbered coverage if a heading is one, else null: no clause, and none of the words of terms and conditions."""
    t = strip(F.regexp_replace(strip(line), r"^[# ]+|[# ]+$", ""))
    other = t.contains("정하지") | t.rlike(r"^제\s*\d+\s*조") | t.rlike(r"용어|풀이|경우|명령|소비자|지났을|무효|금지|처리|제한|해당하는|예금자|가이드|목\s*차|요약|보호제도")
    return F.when(strip(line).startswith("#") & ~other & t.rlike(r"^\d+(-\d+)?\.\s{0,2}\S{2,}"), t)
