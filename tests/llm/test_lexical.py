import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import empty, frame, hard_documents, words
from tessera.llm import lexical

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, queries, k):
    """Every document against every query, straight from the definition."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(docs, queries, k):
    return sorted((tuple(r) for r in lexical.rank_documents(docs, queries, k).collect()), key=repr)


def corpus(n=400):
    rows = hard_documents()
    rows += [(100 + i, " ".join(words(random.Random(i).randint(0, 80), i, 150))) for i in range(n)]
    return rows + [(100 + i, " ".join(words(30, 7, 150))) for i in range(40)]  # equal texts, so equal scores


ITEMS = [(1, " ".join(words(30, 3, 150))), (2, None), (3, "nowhere at all"), (4, "One TWO naïve"), (4, "word word WORD b"), (5, ""), (None, " ".join(words(12, 9, 150))), (6, " ".join(words(400, 11, 300)))]


def test_like_brute_force(spark, monkeypatch):
    rows = corpus()
    docs, items = frame(spark, rows).repartition(3), frame(spark, ITEMS, "item_id long, text string")
    want = brute(rows, ITEMS, 7)
    assert got(docs, items, 7) == want
    # shards of a few documents, several blocks of queries, and frontiers that do not fit
    monkeypatch.setattr(lexical, "SHARD_DOCS", 37)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    monkeypatch.setattr(lexical, "RANGES", 64)
    assert got(docs, items, 7) == want


def test_empty(spark):
    items = frame(spark, ITEMS, "item_id long, text string")
    assert got(empty(spark), items, 5) == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items, 5) == []
    assert got(frame(spark, corpus(3)), empty(spark, "item_id long, text string"), 5) == []


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    """Ranges of a node are the postings of its documents, by falling impact."""
    draw = np.random.default_rng(seed)
    docs = int(draw.integers(1, 70))
    pairs = np.unique(np.stack([draw.integers(0, 9, 200), draw.integers(0, docs, 200)]), axis=1)
    impact = draw.integers(1, 1000, pairs.shape[1])
    tree = lexical.Tree(pairs[0], pairs[1], impact, docs)
    at = np.arange(10)
    nodes = [np.zeros(1, np.int64), np.zeros(1, np.int64), *(x[None, :] for x in tree.ranges(at))]
    for _ in range(tree.levels + 1):
        for level, prefix, start, end in zip(*nodes):
            span = tree.levels - level
            for t in at:
                below = sorted(impact[(pairs[0] == t) & (pairs[1] >> span == prefix)].tolist(), reverse=True)
                assert tree.impact[level, start[t] : end[t]].tolist() == below
        if nodes[0][0] < tree.levels:
            nodes = list(tree.children(*nodes))


def test_nodes_are_left_unopened():
    """Documents that stand out are found without opening most of the tree."""
    draw = np.random.default_rng(1)
    docs, n = 4096, 60_000
    pairs = np.unique(np.stack([draw.integers(0, 40, n), draw.integers(0, docs, n)]), axis=1)
    impact = draw.integers(1, 100, pairs.shape[1])
    impact[np.isin(pairs[1], [17, 900, 3000])] *= 50
    tree, best = lexical.Tree(pairs[0], pairs[1], impact, docs), lexical.Best(3)
    lexical.search(tree, np.arange(40), np.ones(40, np.int64), np.arange(docs), best)
    assert best.scores.tolist() == sorted(np.bincount(pairs[1], impact).astype(int).tolist(), reverse=True)[:3]
    assert set(best.ids.tolist()) == {17, 900, 3000}
    assert tree.opened < docs / 2  # of nearly 2 * docs nodes


def test_long_text_is_split(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 16)
    text = "Alpha beta, alpha!" * 9 + " " + "x" * 50 + " alpha  "
    n, found = lexical.term_counts(text, {b"alpha": 1, b"x" * 50: 2})
    assert (n, found) == (len(terms(text)), Counter({1: terms(text).count("alpha"), 2: 1}))


def test_large_numbers():
    n = np.array([10, 4 * 10**9])
    docs, total, tf = 3 * 10**10, 10**14, np.array([2, 10**6])
    want = [10**9 * t // (1000 * t + 20 * (50 + 50 * m * docs // total)) for t, m in zip(tf.tolist(), n.tolist())]
    assert lexical.impacts(tf, n, docs, total).tolist() == want
