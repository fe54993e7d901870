"""References and quantities in texts, and what follows when an answer's are not in its sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# References and quantities as they are written.
ARTICLE = r"제\s*(\d+)\s*조(?:\s*제\s*(\d+)\s*항)?(?:\s*제\s*(\d+)\s*호)?(?:\s*제\s*(\d+)\s*목)?"
APPENDIX = r"별표\s*(\d+)|부칙(?:\s*제\s*(\d+)\s*조)?|서식\s*(\d+)|양식\s*(\d+)"
NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+)\s*(만\s*원|억\s*원|원|퍼센트|%|개월|일|년|세|살|회)?"
DATE = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"
UNITS = {
    "만원": (10_000.0, "KRW"), "억원": (100_000_000.0, "KRW"), "원": (1.0, "KRW"), "%": (1.0, "PERCENT"), "퍼센트": (1.0, "PERCENT"), "일": (1.0, "DAYS"),
    "개월": (30.0, "DAYS"), "년": (1.0, "YEARS"), "세": (1.0, "AGE"), "살": (1.0, "AGE"), "회": (1.0, "COUNT"),
}
CRITICAL = ["KRW", "DAYS", "YEARS", "PERCENT"]
SENTENCE_END = r"(?<=[.!?다요음])\s+|\n+"
CLOSE = 0.5


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _rows(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g0..gn of every match; a group that took no part is ''. One pass over the text: groups are taken from the matches, as no pattern looks beyond its match."""
    return F.transform(_all(text, pattern, 0), lambda m: F.struct(m.alias("g0"), *[F.regexp_extract(m, pattern, i).alias(f"g{i}") for i in range(1, groups + 1)]))


def _number(s: Column) -> Column:
    return F.nullif(s, F.lit("")).cast("int")


def article_refs(text: Column) -> Column:
    """array<struct<article, paragraph, subparagraph, item, canonical>>; a zero leaves its level out of the canonical form."""

    def one(m: Column) -> Column:
        parts = [_number(m[f"g{i}"]) for i in (1, 2, 3, 4)]
        form = F.concat_ws(" ", *[F.when(F.nullif(p, F.lit(0)).isNotNull() if i else p.isNotNull(), F.concat(F.lit("제"), p.cast("string"), F.lit(unit))) for i, (p, unit) in enumerate(zip(parts, "조항호목"))])
        return F.struct(*[p.alias(n) for p, n in zip(parts, ("article", "paragraph", "subparagraph", "item"))], form.alias("canonical"))

    return F.transform(_rows(text, ARTICLE, 4), one)


def appendix_refs(text: Column) -> Column:
    """array<struct<kind, number, canonical>>"""

    def one(m: Column) -> Column:
        kind = F.when(m.g1 != "", "별표").when(m.g0.startswith("부칙"), "부칙").when(m.g3 != "", "서식").otherwise("양식")
        number = F.coalesce(_number(m.g1), _number(m.g2), _number(m.g3), _number(m.g4))
        form = F.when(kind == "부칙", F.concat_ws(" ", F.lit("부칙"), F.when(F.nullif(number, F.lit(0)).isNotNull(), F.concat(F.lit("제"), number.cast("string"), F.lit("조"))))).otherwise(F.concat_ws(" ", kind, F.nullif(number, F.lit(0)).cast("string")))
        return F.struct(kind.alias("kind"), number.alias("number"), form.alias("canonical"))

    return F.transform(_rows(text, APPENDIX, 4), one)


def numeric_facts(text: Column) -> Column:
    """array<struct<value, unit, canonical>> of numbers with units, then of dates, whose value is 0."""
    spec = F.create_map(*[F.lit(x) for unit, (factor, code) in UNITS.items() for x in (unit, f"{factor}|{code}")])

    def one(m: Column) -> Column:
        found = spec[F.regexp_replace(m.g2, " ", "")]
        value = F.regexp_replace(m.g1, ",", "").cast("double") * F.substring_index(found, "|", 1).cast("double")
        unit = F.substring_index(found, "|", -1)
        return F.struct(value.alias("value"), unit.alias("unit"), F.concat(value.cast("decimal(24,1)").cast("string"), F.lit(":"), unit).alias("canonical"))

    known = F.filter(_rows(text, NUMBER, 2), lambda m: spec[F.regexp_replace(m.g2, " ", "")].isNotNull())
    dates = F.transform(_all(text, DATE, 0), lambda d: F.struct(F.lit(0.0).alias("value"), F.lit("DATE").alias("unit"), F.lit("0:DATE").alias("canonical")))
    return F.concat(F.transform(known, one), dates)


def claims(answer: Column) -> Column:
    """Sentences and lines of an answer, trimmed, without empty ones."""
    trimmed = F.transform(F.split(answer, SENTENCE_END), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda c: c != "")


def canonicals(refs: Column) -> Column:
    return F.array_distinct(F.transform(refs, lambda r: r.canonical))


def missing(found: Column, sources: Column) -> Column:
    return F.array_sort(F.array_except(found, sources))


def risk(missing_refs: Column, mismatched_units: Column) -> Column:
    """hard_fail, soft_fail, warn or pass."""
    critical = F.exists(mismatched_units, lambda u: u.isin(CRITICAL))
    return F.when(F.size(missing_refs) > 0, "hard_fail").when(critical, "soft_fail").when(F.size(mismatched_units) > 0, "warn").otherwise("pass")


def article_number(canonical: Column) -> Column:
    return _number(F.regexp_extract(canonical, r"제\s*(\d+)\s*조", 1))


def paragraph_number(canonical: Column) -> Column:
    return _number(F.regexp_extract(canonical, r"제\s*(\d+)\s*항", 1))


def adjacent(ref: Column, sources: Column) -> Column:
    """Whether a source's reference is one article or one paragraph off, or has a level that the other lacks."""
    a, p = article_number(ref), paragraph_number(ref)

    def near(c: Column) -> Column:
        x, y = article_number(c), paragraph_number(c)
        same = (x == a) & ((F.abs(y - p) <= 1) | (y.isNull() != p.isNull()))
        return F.coalesce((F.abs(x - a) == 1) | same, F.lit(False))

    return a.isNotNull() & F.exists(sources, near)


def close(value: Column, unit: Column, facts: Column) -> Column:
    """Whether a source has the same unit and a value less than CLOSE off, relative to the larger."""
    near = lambda f: (f.unit == unit) & (F.greatest(F.abs(value), F.abs(f.value)) > 0) & (F.abs(value - f.value) / F.nullif(F.greatest(F.abs(value), F.abs(f.value)), F.lit(0.0)) < CLOSE)
    return (value != 0) & F.coalesce(F.exists(facts, near), F.lit(False))


def failure(missing_refs: Column, mismatches: Column, source_refs: Column, source_facts: Column, judged: Column | None = None) -> Column:
    """generation_error, retrieval_gap, unit_error, semantic_mismatch (only if a judge's verdict is given) or minor."""
    neighbour = F.exists(missing_refs, lambda m: adjacent(m, source_refs))
    unit = F.exists(mismatches, lambda m: m.unit.isin(CRITICAL) & close(m.value, m.unit, source_facts))
    out = F.when(F.size(missing_refs) > 0, F.when(neighbour, "generation_error").otherwise("retrieval_gap")).when(unit, "unit_error")
    return (out if judged is None else out.when(judged, "semantic_mismatch")).otherwise("minor")
