import hashlib

import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import empty, frame, hard_documents
from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_like_tiktoken_and_back(spark, reference):
    rows = hard_documents()
    got = bpe.encode(frame(spark, rows), PATH).collect()
    assert len(got) == len(rows)
    want = sorted((d or -1, reference.encode_ordinary(t or "")) for d, t in rows)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)
    ids = spark.createDataFrame([(1, reference.encode_ordinary("héllo")), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(ids, PATH).collect()} == {1: "héllo".encode(), 2: None, 3: b""}
    assert bpe.encode(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("text", ["", "a", "  a", "a  b", "x\u0085y  ", "'s't I'll  \n\n x", "a" * 3000, "é" * 50 + "　　z", "\U0001f600\r\n\t 12345 ab12", "\x1c a\x1f", "Ⅷ½²٣ x", "ab" * 700, " don't.\t\tstop"])
def test_pieces(reference, text):
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_digest(spark):
    row = bpe.digest(bpe.encode(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), PATH)).first()
    assert row.decoded_sha256 == hashlib.sha256(b"two words").hexdigest()
    assert row.n_tokens >= 2
