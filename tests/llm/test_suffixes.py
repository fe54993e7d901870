import random
from collections import Counter

import pytest

from tests.llm.helpers import empty, frame, hard_documents, words
from tessera.llm import suffixes


def brute(rows, length=suffixes.LENGTH):
    texts = [(d, (t or "").encode()) for d, t in rows]
    c = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def passages():
    a, b = " ".join(words(90, 20, 400)), " ".join(words(70, 21, 400))
    rows = [(i, " ".join(words(50 + i, 30 + i)) + " " + (a if i % 2 else b) + " " + " ".join(words(20, 60 + i))) for i in range(12)]
    rows += [(20, a[:199]), (21, a[:200]), (22, "z" * 450), (23, b[100:] + "é" + b[:260]), (24, a[:150] + "!" + a[151:])]
    return rows


@pytest.mark.parametrize("key_bytes", [4 << 20, 300])
def test_against_all_windows(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(suffixes, "KEY_BYTES", key_bytes)
    for rows in (passages(), hard_documents()):
        got = suffixes.remove_repeats(frame(spark, rows)).collect()
        have = [(r.doc_id, len(r.text), sum(s.b - s.a for s in r.spans), len(r.spans), bytes(r.kept)) for r in got]
        assert sorted(have, key=str) == brute(rows)
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_merged_transforms():
    draw = random.Random(3)
    for trial in range(60):
        length = draw.choice([3, 5, 8])
        strings = list({bytes(draw.choices(b"ab" if trial % 2 else b"abcd", k=draw.randint(1, 40))) for _ in range(draw.randint(1, 12))})
        got = suffixes.repeated(strings, length, draw.choice([10, 40, 1000]))
        c = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        assert [g.tolist() for g in got] == [[i for i in range(len(s) - length + 1) if c[s[i : i + length]] > 1] for s in strings]


def test_suffix_array():
    import numpy as np

    draw = np.random.default_rng(1)
    for n in (1, 2, 17, 200):
        text = draw.integers(0, 3, n).astype(np.int16)
        assert suffixes.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_scans_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "SCAN", 1000)
    for n in (0, 199, 200, 999, 1000, 1199, 1200, 5000):
        text = bytes(i % 251 for i in range(n))
        at = [a + i for a, data in suffixes.scans(text) for i in range(len(data) - suffixes.LENGTH + 1)]
        assert at == list(range(max(0, n - suffixes.LENGTH + 1)))


def test_query_and_a_very_long_text(spark, tmp_path):
    import hashlib

    long = " ".join(words(300_000, 5, 100_000))
    rows = [*passages(), *hard_documents(), (900, long + long[:300]), (901, long[-250:])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffixes.op2_suffix_dedup(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
