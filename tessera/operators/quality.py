"""Measures and gates over runs and documents: accuracy, gaps between segments, bottlenecks, latency, parse and chunk quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ranks, substrings
from tessera.shared import written

#: Targets of the decision table, and bounds of the gate.
RECALL_5, RECALL_3, FAITHFULNESS, RELEVANCY, GAP = 0.95, 0.90, 0.80, 0.80, 0.1
HANGUL_LEAST, FEWEST_CLAUSES, MOST_CLAUSES, LONGEST_CLAUSE = 0.30, 5, 60, 1600
#: Ranks whose hits are searched for anchors first.
FIRST = 64
FRAGMENT_TAIL, STRUCTURE_MARK = r"(?:다|요|음|함|됨|임)\s*[.。]$", r"제\s*\d+\s*[조관장절편]|별표|【"


def _ratio(a: Column, b: Column) -> Column:
    return F.round(a / b, 6)


def accuracy(rows: DataFrame, expected: Column, predicted: Column, *by: str) -> DataFrame:
    """Rows, hits and their share for all rows and by the given columns; null equals null."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.sum(expected.eqNullSafe(predicted).cast("long")).alias("hits")).withColumn("accuracy", _ratio(F.col("hits"), F.col("n")))


def answers_by_field(wide: DataFrame, golden: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Golden rows (key, field, expected) with the value of the column that field names: expected, predicted."""
    long = wide.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("predicted")) for f in fields])).alias("x")).select(key, "x.*")
    return golden.join(long, [key, "field"], "left").select(key, "field", "expected", "predicted")


def segment_gap(measures: DataFrame, first: str = "domain", second: str = "general") -> DataFrame:
    """weaker, stronger or even: the first segment against the second, by recall_1 and mrr; either gap counts as strength, both as weakness."""
    of = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    recall, mrr = of(second, "recall_1") - of(first, "recall_1"), of(second, "mrr") - of(first, "mrr")
    verdict = F.when((recall >= GAP) & (mrr >= GAP), "weaker").when((recall <= -GAP) | (mrr <= -GAP), "stronger").otherwise("even")
    return measures.agg(F.round(recall, 6).alias("recall_gap"), F.round(mrr, 6).alias("mrr_gap"), verdict.alias("verdict"))


def diagnose(runs: DataFrame) -> DataFrame:
    """Where each run's bottleneck is: run, verdict, gate.

    runs: run, recall_5, recall_3 (both null: not measured), faithfulness, relevancy (null or NaN: not
    measured), biased. Retrieval first; generation only counts as measured by an unbiased judge.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    enough = F.coalesce(F.col("recall_5") >= RECALL_5, F.lit(False)) | F.coalesce(F.col("recall_3") >= RECALL_3, F.lit(False))
    measured = (number("faithfulness") | number("relevancy")) & ~F.coalesce("biased", F.lit(False))
    weak = (number("faithfulness") & (F.col("faithfulness") < FAITHFULNESS)) | (number("relevancy") & (F.col("relevancy") < RELEVANCY))
    unknown = F.col("recall_5").isNull() & F.col("recall_3").isNull()
    verdict = F.when(unknown, "unknown").when(~enough, "retrieval-bound").when(measured & weak, "generation-bound").when(weak, "generation-leaning").when(measured, "healthy").otherwise("unknown")
    gate = F.when(F.col("verdict") == "retrieval-bound", "conditional").when(F.col("verdict") == "generation-bound", "open").when(F.col("verdict") == "healthy", "closed").otherwise("blocked")
    return runs.select("run", verdict.alias("verdict")).withColumn("gate", gate)


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, least, median and the value at the lower rank of 95 in a hundred of each group."""
    n = F.col("n")
    wanted = {"least": F.lit(0), "low": F.floor((n + 1) / 2) - 1, "high": F.floor(n / 2), "p95": ranks.lower_rank(0.95)}
    found = ranks.at_ranks(rows, [by], value, wanted, {"mean": F.round(F.avg("v"), 6)})
    return found.select(by, "n", "mean", "least", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95")


def basic_stats(answers: DataFrame, by: str) -> DataFrame:
    """Answers of each document, refusals, those that were retried, and seconds: mean, least, most."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return answers.groupBy(by).agg(F.count("*").alias("n"), count(is_refusal(F.col("answer"))).alias("refusals"), count(F.col("retries") > 0).alias("retried"), F.round(F.avg("seconds"), 6).alias("mean_s"), F.min("seconds").alias("least_s"), F.max("seconds").alias("most_s"))


def is_refusal(answer: Column) -> Column:
    """Either of the two phrases in which an answer says that it has none."""
    return answer.contains("확인되지 않음") | answer.contains("관련 내용을 찾지 못했습니다")


def recognition_stats(images: DataFrame) -> DataFrame:
    """By document: images (doc, image, content, scores array<double> or null: not recognised), their verdicts, scores in four ranges, and the mean score."""
    verdict = text.ocr_verdict(F.col("content"))
    done = images.filter(F.col("scores").isNotNull())
    scores = done.select("doc", F.explode("scores").alias("s"))
    inside = lambda a, b: F.sum(((F.col("s") >= a) & (F.col("s") < b)).cast("long"))
    ranges = scores.groupBy("doc").agg(inside(0.9, 1.01).alias("from_90"), inside(0.8, 0.9).alias("from_80"), inside(0.5, 0.8).alias("from_50"), inside(0.0, 0.5).alias("below_50"), F.round(F.avg("s"), 6).alias("mean_score"))
    verdicts = images.withColumn("v", F.when(F.col("scores").isNotNull(), verdict)).groupBy("doc")
    counts = verdicts.agg(F.count("*").alias("images"), F.count("v").alias("recognised"), *[F.sum((F.col("v") == v).cast("long")).alias(v) for v in ("passed", "empty", "too_short", "special_only", "math_noise", "low_lang_ratio")])
    return counts.join(ranges, "doc", "left")


def lowest(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in a total order, with their rank; each task keeps n of a group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def prune_breakdown(images: DataFrame) -> DataFrame:
    """How many images (present, size, width, height, stddev) each filter takes out, and how many stay (ok)."""
    verdict = text.image_verdict(F.col("present"), F.col("size"), F.col("width"), F.col("height"), F.col("stddev"))
    return images.groupBy(verdict.alias("reason")).agg(F.count("*").alias("n"))


def chunk_quality(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks (heading_path, content) of each group that hold image tags, page marks, leaders or break tags, or stand under a piece of a sentence."""
    has = lambda p: F.sum(F.coalesce(F.col("content").rlike(p), F.lit(False)).cast("long"))
    return chunks.groupBy(by).agg(F.count("*").alias("n"), has(r"!\[[^\]]*\]\(").alias("img"), has(r"<!--\s*page").alias("page"), has(r"\.{4,}|·{4,}|…{3,}").alias("dots"), has(r"(?i)<br\s*/?>").alias("br"), F.sum(is_fragment(leaf(F.col("heading_path"))).cast("long")).alias("frag"))


def leaf(path: Column) -> Column:
    return text.strip(F.coalesce(F.element_at(F.split(path, " > "), -1), F.lit("")))


def is_fragment(title: Column) -> Column:
    """A heading that ends as a sentence does and has no mark of structure."""
    return title.rlike(FRAGMENT_TAIL) & ~title.rlike(STRUCTURE_MARK)


def format_profile(docs: DataFrame) -> DataFrame:
    """By document (doc, text): clause titles in full-width and in half-width brackets, which of them it uses, whether it is compound, page marks."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    own = docs.select("doc", count(r"제\s*\d+\s*조\s*【").alias("titles_full"), count(r"제\s*\d+\s*조\s*\(").alias("titles_half"), (count("특별약관") > 5).alias("compound"), count("<!-- page:").alias("page_marks"))
    return own.withColumn("format", F.when(F.col("titles_full") >= F.col("titles_half"), "full").otherwise("half"))


def document_gate(docs: DataFrame, parsed: DataFrame, annexes: DataFrame) -> DataFrame:
    """doc, check, verdict of the checks of a parsed document: share of Hangul; compound, or else numbers 1 to n and how many; empty and long clauses; annexes referred to.

    docs: doc, text; parsed: as structure.clauses gives it (the first run counts, several make it compound);
    annexes: doc, no. References to annexes of other laws, by what stands before them, are left aside.
    """
    solid = F.greatest(F.length(F.regexp_replace("text", r"\s", "")), F.lit(1))
    hangul = F.regexp_count("text", F.lit("[가-힣]")) / solid >= HANGUL_LEAST
    pattern = r"(?s)(.{0,20})별\s*표\s*(\d+)"
    before, number = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    refs = F.transform(F.filter(F.arrays_zip(before.alias("b"), number.alias("n")), lambda x: ~x.b.rlike(r"[」』]|시행규칙|시행령|법\s*$|규칙")), lambda x: x.n.cast("int"))
    own = docs.select("doc", hangul.alias("hangul"), F.array_distinct(refs).alias("refs"))
    first = F.col("run") == 0
    of = parsed.groupBy("doc").agg(
        F.countDistinct("run").alias("runs"),
        F.sum(first.cast("int")).alias("n"),
        F.max(F.when(first, F.col("jo"))).alias("last"),
        F.coalesce(F.max((first & (text.strip(F.col("body")) == "")).cast("int")), F.lit(0)).alias("blank"),
        F.coalesce(F.max((first & (F.length("body") > LONGEST_CLAUSE)).cast("int")), F.lit(0)).alias("long"),
    )
    held = annexes.groupBy("doc").agg(F.collect_set("no").alias("nos"))
    rows = own.join(of, "doc", "left").join(held, "doc", "left")
    n, runs = F.coalesce("n", F.lit(0)), F.coalesce("runs", F.lit(0))
    open_refs = F.array_except("refs", F.coalesce("nos", F.array().cast("array<int>")))
    verdict = lambda name, ok, bad, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("verdict")))
    checks = F.array(
        verdict("hangul", F.col("hangul"), "FAIL"),
        verdict("compound", F.lit(False), "WARN", runs >= 2),
        verdict("in_order", F.coalesce(F.col("last"), F.lit(0)) == n, "FAIL", runs < 2),
        verdict("clauses", n.between(FEWEST_CLAUSES, MOST_CLAUSES), "FAIL", runs < 2),
        verdict("blank", F.coalesce(F.col("blank"), F.lit(0)) == 0, "WARN"),
        verdict("length", F.coalesce(F.col("long"), F.lit(0)) == 0, "WARN"),
        verdict("annexes", F.size(open_refs) == 0, "WARN"),
    )
    return rows.select("doc", F.explode(F.array_compact(checks)).alias("c")).select("doc", "c.*")


def grounding(products: DataFrame, parsed: DataFrame, annexes: DataFrame) -> DataFrame:
    """doc, check, verdict (PASS, REJECT or NA) of what was extracted: the coverage's name in the clause that grants it, the annex it names, and the body of each excluding clause."""
    grant = parsed.filter(F.col("title").contains("지급사유")).groupBy("doc").agg(F.min_by("body", F.struct("run", "jo")).alias("grant"))
    nos = annexes.groupBy("doc").agg(F.collect_set("no").alias("nos"))
    rows = products.join(grant, "doc", "left").join(nos, "doc", "left")
    judged = lambda value, ok: F.when(value.isNull(), "NA").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("REJECT")
    known = F.array_contains(F.coalesce("nos", F.array().cast("array<int>")), F.col("payout_annex"))
    own = rows.select("doc", F.explode(F.array(F.struct(F.lit("coverage_name").alias("check"), judged(F.col("coverage_name"), F.col("grant").contains(F.col("coverage_name"))).alias("verdict")), F.struct(F.lit("payout_annex").alias("check"), judged(F.col("payout_annex"), known).alias("verdict")))).alias("c"))
    excluding = parsed.filter(F.col("title").rlike("지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책"))
    says = F.col("body").rlike("지급하지 않|지급하지아니|보상하지 않|보장하지 않")
    bodies = excluding.select("doc", F.struct(F.concat(F.lit("exclusion_"), F.col("run").cast("string"), F.lit("_"), F.col("jo").cast("string")).alias("check"), F.when(says, "PASS").otherwise("REJECT").alias("verdict")).alias("c"))
    return own.union(bodies).select("doc", "c.*")


def gate_totals(verdicts: DataFrame) -> DataFrame:
    """What of the values that were tried passes into tables, what is refused, and the share."""
    count = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0))
    return verdicts.agg(count("PASS").alias("passed"), count("REJECT").alias("rejected")).withColumn("precision", F.when(F.col("passed") + F.col("rejected") > 0, _ratio(F.col("passed"), F.col("passed") + F.col("rejected"))))


def resolution_rate(refs: DataFrame) -> DataFrame:
    """By document: references to clauses, those that resolve, their share, and low below nine in ten. refs: as structure.clause_refs gives them."""
    own = refs.filter("ref_type = '조항'").groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.col("resolved").cast("long")).alias("resolved"))
    return own.withColumns({"rate": _ratio(F.col("resolved"), F.col("n")), "low": F.col("resolved") / F.col("n") < 0.9})


def density(parsed: DataFrame, most_chars: int = 30_000) -> DataFrame:
    """By document: contracts, clauses, characters a clause, and whether so many that the parse looks wrong."""
    own = parsed.groupBy("doc").agg(F.countDistinct("run").alias("contracts"), F.count("*").alias("clauses"), F.sum(F.length("body").cast("long")).alias("chars"))
    return own.withColumns({"chars_each": _ratio(F.col("chars"), F.col("clauses")), "suspect": F.col("chars") / F.col("clauses") > most_chars})


def anchor_ranks(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id and the least rank of a hit (query_id, rank, content) that holds one of the question's anchors (query_id, anchor), both without white space in lower case.

    Hits are searched from the first on, FIRST ranks at a time and then eight times as many, and only those of questions that have not found one: a later hit cannot be the least.
    """
    tight = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    needles = written(anchors.select("query_id", tight(F.col("anchor")).alias("needle")).distinct().withColumn("nid", F.col("needle")))
    texts = written(hits.join(F.broadcast(needles.select("query_id").distinct()), "query_id", "left_semi").select("query_id", F.col("rank").alias("tid"), tight(F.col("content")).alias("text")))
    asked = written(texts.groupBy("query_id").agg(F.min("tid").alias("least"), F.max("tid").alias("most")))
    found, left, before, upto = None, asked, asked.agg(F.min("least")).first()[0], FIRST
    while not left.isEmpty():
        own = texts.filter((F.col("tid") >= before) & (F.col("tid") < before + upto)).join(F.broadcast(left), "query_id", "left_semi")
        wanted = needles.join(F.broadcast(left), "query_id", "left_semi")
        best = written(substrings.containing(own, wanted, ["query_id"]).groupBy("query_id").agg(F.min("tid").alias("first")))
        found = best if found is None else found.union(best)
        before, upto = before + upto, upto * 8
        left = written(left.join(best, "query_id", "left_anti").filter(F.col("most") >= before))
    if found is None:
        return asked.select("query_id", F.lit(None).cast(texts.schema["tid"].dataType).alias("first"))
    return asked.select("query_id").join(found, "query_id", "left")


def first_either_way(wanted: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """For each wanted (key, id, name) the first rule (key, ord, name; ord tells rules of a key apart) whose name is part of the wanted one or has it as a part; both names meet by key."""
    names, rule = wanted.select(key, "name").distinct(), rules.select(key, "ord", F.col("name").alias("rule"))
    inside = substrings.containing(rule.select(key, F.col("ord").alias("tid"), F.col("rule").alias("text")), names.select(key, F.col("name").alias("nid"), F.col("name").alias("needle")), [key]).select(key, F.col("nid").alias("name"), F.col("tid").alias("ord"))
    around = substrings.containing(names.select(key, F.col("name").alias("tid"), F.col("name").alias("text")), rule.select(key, F.col("ord").alias("nid"), F.col("rule").alias("needle")), [key]).select(key, F.col("tid").alias("name"), F.col("nid").alias("ord"))
    first = inside.union(around).groupBy(key, "name").agg(F.min("ord").alias("ord")).join(rule, [key, "ord"])
    return wanted.select(key, "id", "name").join(first, [key, "name"], "left").select(key, "id", "name", "ord", "rule")


def annex_refs_open(docs: DataFrame, annexes: DataFrame) -> DataFrame:
    """doc and the numbers of annexes that its text names and that it lacks, in order."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"별\s*표\s*(\d+)"), F.lit(1)).cast("array<int>"))
    held = annexes.groupBy("doc").agg(F.collect_set("no").alias("nos"))
    return docs.join(held, "doc", "left").select("doc", F.array_sort(F.array_except(refs, F.coalesce("nos", F.array().cast("array<int>")))).alias("missing"))


def titled_exclusions(parsed: DataFrame, n: int = 3) -> DataFrame:
    """The first n titles of excluding clauses of each document."""
    own = parsed.filter(F.col("title").rlike("지급하지 않|지급하지아니|보상하지 않|보장하지 않|면책"))
    return lowest(own.select("doc", "run", "jo", "title"), ["doc"], ["run", "jo"], n)

