"""Verification of answers against their sources: missing references, mismatched quantities, risk, failure class, groundedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import facts
from tessera.operators.barrier import once


def _plain(text: Column) -> Column:
    """References by article number alone, and appendices."""
    return _articles(facts.article_refs(text), F.transform(facts.appendix_refs(text), lambda r: r.canonical))


def _articles(articles: Column, appendices: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(articles, lambda r: F.concat(F.lit("제"), r.article.cast("string"), F.lit("조"))), appendices))


def _forms(numbers: Column) -> Column:
    return F.array_distinct(F.transform(numbers, lambda n: n.canonical))


def verify(answers: DataFrame, judge=None) -> DataFrame:
    """Adds missing_refs, mismatches (canonical forms), risk, failure, groundedness and warnings to rows of (answer, context).

    References are matched by article number alone. Groundedness is the share of verifiable claims with a
    reference that the context has; null without any. judge: an optional condition (answer, context) for a
    reversed meaning.
    """
    a, c = F.col("answer"), F.col("context")
    staged = once(answers, {
        "__articles": facts.article_refs(c), "__appendices": facts.canonicals(facts.appendix_refs(c)), "__refs": _plain(a),
        "__numbers": facts.numeric_facts(a), "__facts": facts.numeric_facts(c),
        "__claims": F.transform(facts.claims(a), lambda x: F.struct(_plain(x).alias("refs"), F.size(facts.numeric_facts(x)).alias("numbers"))),
    })
    staged = once(staged, {"__sources": _articles(F.col("__articles"), F.col("__appendices")), "__full": F.array_distinct(F.concat(facts.canonicals(F.col("__articles")), F.col("__appendices")))})
    staged = once(staged, {
        "missing_refs": facts.missing(F.col("__refs"), F.col("__sources")),
        "mismatches": facts.missing(_forms(F.col("__numbers")), _forms(F.col("__facts"))),
    })
    wrong = F.filter("__numbers", lambda n: F.array_contains(F.col("mismatches"), n.canonical))
    units = F.transform("mismatches", lambda m: F.substring_index(m, ":", -1))
    checked = F.transform("__claims", lambda x: F.struct((F.size(x.refs) + x.numbers > 0).alias("verifiable"), F.arrays_overlap(x.refs, F.col("__sources")).alias("supported")))
    verdict = None if judge is None else judge(a, c)
    out = once(staged, {
        "risk": facts.risk(F.col("missing_refs"), units),
        "failure": facts.failure(F.col("missing_refs"), wrong, F.col("__full"), F.col("__facts"), verdict),
        "__checked": checked,
    })
    verifiable = F.size(F.filter("__checked", lambda x: x.verifiable))
    supported = F.size(F.filter("__checked", lambda x: F.coalesce(x.supported, F.lit(False))))
    sample = lambda label, items: F.when(F.size(items) > 0, F.format_string(label, F.size(items), F.array_join(F.slice(items, 1, 5), ", ")))
    out = out.withColumns({
        "claims": F.size("__claims"), "verifiable_claims": verifiable, "supported_claims": supported,
        "groundedness": F.when(verifiable > 0, F.round(supported / verifiable, 3)),
        "warnings": F.array_compact(F.array(sample("references not in the sources (%d): %s", F.col("missing_refs")), sample("quantities not in the sources (%d): %s", F.col("mismatches")))),
        "hint": F.when(F.col("failure").isin("generation_error", "unit_error"), F.concat_ws("\n", F.concat(F.lit("use only: "), F.array_join(F.array_sort("__full"), ", ")), F.concat(F.lit("do not use: "), F.array_join(F.concat("missing_refs", "mismatches"), ", ")))),
    })
    return out.drop("__articles", "__appendices", "__refs", "__sources", "__full", "__numbers", "__facts", "__claims", "__checked")


def provenance(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that support each claim: answers (id, answer), chunks (id, chunk_id, content) of the answer's context.

    Returns id, claim_no, claim, chunk_ids (sorted). References join on their canonical forms, so a claim
    meets only chunks that share one.
    """
    claims = answers.select("id", F.posexplode(facts.claims(F.col("answer"))).alias("claim_no", "claim"))
    refs = claims.select("id", "claim_no", F.explode(_plain(F.col("claim"))).alias("ref"))
    held = chunks.select("id", "chunk_id", F.explode(_plain(F.col("content"))).alias("ref"))
    found = refs.join(held, ["id", "ref"]).groupBy("id", "claim_no").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    none = F.array().cast(found.schema["chunk_ids"].dataType)
    return claims.join(found, ["id", "claim_no"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", none))
