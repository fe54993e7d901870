import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import words
from tessera.llm import bpe

EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun while they watch this thing of theirs"
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der sonne nicht mehr auch heute"
ITEM = " ".join(words(40, 77))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Columns of documents, and some whose names the operators use themselves."""
    frame = spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows], SCHEMA)
    return frame.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("__oid", "__th", "__gone", "__lang", "row", "gone", "h1", "uid", "band", "component_id", "ids", "spans", "word", "n_lines", "n_removed", "n")})


def rows():
    english = [(i, f"{EN} {' '.join(words(12, i, 500))}", "en") for i in range(20)]
    german = [(20 + i, f"{DE} {' '.join(words(12, 50 + i, 500))}", "de") for i in range(20)]
    shared = "a line of text that many of the documents have in them"
    return [
        *english, *german,
        (50, None, "en"), (51, "", "en"), (52, " \n\t", None), (53, "123 456", "de"),
        (60, f"{shared}\n{EN} first", "en"), (61, f"{shared}!\n{EN} second of the texts", None), (62, shared, "en"),
        (70, f"{EN} the one and {EN}", "en"), (71, f"{EN} the one and {EN}", "en"), (71, f"{EN} the one and {EN}", "en"), (None, f"{DE} ohne", "de"),
        (80, f"{EN} {ITEM} {DE}", "en"),
        (90, " ".join([EN, *words(30000, 3, 5000)]), "en"),
    ]


def test_every_stage_on_hard_rows(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows())
    columns = docs.columns
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if name == "tokens":
            break
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        found = docs.collect()
        assert all(r.doc_id is None or r[c] == f"{c}{r.doc_id}" for r in found for c in columns[5:]), name
        assert all(r.n_chars == len(r.text) for r in found)
        texts[name] = [(r.doc_id, r.text) for r in found]
    ids = {name: {d for d, _ in own} for name, own in texts.items()}
    assert not ids["language"] & {50, 51, 52, 53} and {0, 20, 60, 71, 80, 90, None} <= ids["language"]
    assert ids["language"] - ids["lines"] == {62, 71}  # of 62 and 71 nothing is left
    assert dict(texts["lines"])[61] == f"{EN} second of the texts"
    assert ids["lines"] - ids["near_copies"] <= {1, 2, 60, 61} | set(range(40)) and 0 in ids["near_copies"]
    assert ids["near_copies"] - ids["benchmark"] == {80}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = [(d, own.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts["benchmark"]]
    assert sorted(((r.doc_id, list(r.ids), r.decoded_sha256) for r in docs.collect()), key=str) == sorted(want, key=str)
    assert docs.filter(F.col("n_tokens") != F.size("ids")).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_every_stage_on_an_empty_table_and_on_nulls(spark, tmp_path, k):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, documents(spark, rows()).limit(0), str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    assert stage(spark, nulls, str(tmp_path)).count() == (0 if name == "language" else 3)
