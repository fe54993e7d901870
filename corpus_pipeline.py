"""From raw documents to token ids: language, lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what a stage returns to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, linededup, minhash
from tessera.llm.common import scratch, table

#: The least share of the probability that a document's language needs.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the languages that the labels name.

    Goes: no letter (so null and empty texts), or no language above LEAST_SHARE, as all do where no row has a
    label. Ties go to the language that sorts first. Repeated rows are judged each and alike, very long texts
    whole; an empty table stays empty; further columns, of any name, stay as they are.
    """
    models = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.language(spark, models, F.col("text"))
    return docs.filter((found.lang_pred != langid.UNDETERMINED) & (found.score >= LEAST_SHARE))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier one nearly equals, and short ones that an earlier one equals, white space alone aside.

    Goes: a document that lost lines and of which nothing but white space is left. Null and empty texts lose
    nothing and stay. Earlier is by doc_id (null last), then by place, so no two lines tie; repeated rows keep
    the same lines, very long texts and lines are compared whole. An empty table stays empty. n_chars follows the text; further columns, of
    any name, stay as they are.
    """
    kept = linededup.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("row")), exact_chars=1).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[column.alias(c) for c, column in own.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies, and those without id.

    Documents without words, or with a null text, are copies of nothing and stay; rows of one id stay or go
    together. An empty table stays empty; further columns, of any name, stay as they are.
    """
    gone = minhash.near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: a document that holds a near copy of a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged each and alike, very long texts whole. An
    empty table, or benchmark, takes nothing away; further columns, of any name, stay as they are.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded_sha256 of the bytes that the ids decode to, for each row.

    A null or empty text has no ids. Repeated rows are encoded each, very long texts whole; an empty table stays
    empty; further columns are left out.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: The first stage's models are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
