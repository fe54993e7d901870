import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import empty, frame, hard_documents
from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least=3, top=200):
    """Straight from the definition, in whole numbers of Python."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def chances(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        q, p = chances(whole), {s: chances(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(other, sum((p[s][t] - p[other][t]) ** 2 // p[other][t] for t in kept)) for other in sources if other != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def documents():
    draw = random.Random(3)
    rows = [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "b", "", None])) for i, t in hard_documents() for _ in range(3)]
    pool = ["".join(draw.choices("abcÄé", k=draw.randint(1, 4))) for _ in range(60)]
    rows += [(i, " ".join(draw.choices(pool, k=draw.randint(0, 60))).capitalize(), draw.choice(["en", "en", "fr"]), f"s{draw.randint(0, 9)}") for i in range(300)]
    return [*rows, (900, "alone once", "xx", "s1"), (901, None, "xx", "s2"), (902, "only", "yy", "s"), (903, "x" * 70000 + " y", "en", "s0")]


def got(frame_, **options):
    return sorted(tuple(r) for r in divergence.audit(frame_, **options).collect())


def test_like_brute_force(spark, monkeypatch):
    rows = documents()
    want = brute(rows)
    docs = frame(spark, rows, SCHEMA).repartition(3)
    assert got(docs) == want
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "TILE", 3)
    assert got(docs) == want
    assert got(docs, least_docs=1, terms=4) == brute(rows, 1, 4)


def test_empty(spark):
    assert got(empty(spark, SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None, None), (2, "", "", "b")], SCHEMA)) == brute([(1, None, None, None), (2, "", "", "b")])


@pytest.mark.parametrize("digest", [lambda b: 7, lambda b: len(b)])
def test_terms_that_share_a_hash(digest):
    text = "aa b AA cc b dddd aa".encode()
    low = divergence.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = divergence.bounds(low, np.array([0, len(text)]))
    terms, number = divergence.grouped(low, starts, ends, digest)
    assert [terms[i] for i in number] == [b"aa", b"b", b"aa", b"cc", b"b", b"dddd", b"aa"]
    assert len(set(terms)) == len(terms) == 4


def test_terms_end_with_their_text():
    texts = ["ab", "", "cd e", "f"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends = divergence.bounds(divergence.LOWER[np.frombuffer(data, np.uint8)], offsets)
    assert [data[a:b] for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e", b"f"]


def test_large_counts(spark):
    """Beyond 64 bits before the division."""
    row = spark.createDataFrame([(5 * 10**12, 9 * 10**12, 10**6)], "n long, total long, v long").select(divergence.chance("n", "total", "v")).first()
    assert row[0] == 1 + 10**9 * (5 * 10**12 + 1) // (9 * 10**12 + 10**6)


def test_tasks_send_on_what_they_hold(spark, monkeypatch):
    rows = [(i, f"w{i % 7} same Same", "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = got(docs)
    monkeypatch.setattr(divergence, "GATHERED", 2)
    monkeypatch.setattr(divergence, "CHUNK", 16)
    assert got(docs) == want == brute(rows)
