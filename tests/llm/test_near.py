import random

import numpy as np

from tests.llm.helpers import empty, frame, hard_documents, words
from tessera.llm import minhash
from tessera.llm.components import components


def brute(rows):
    """doc_id, n_shingles, component_id, kept by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = []
    for d, s in sets:
        if d is not None:
            out.append((d, len(s), find(d), find(d) == d))
        else:
            same = [find(e) for e, t in sets if e is not None and s and t == s]
            out.append((None, len(s), min(same) if same else None, False))
    return sorted(out, key=str)


def near_rows():
    draw = random.Random(5)
    base = words(140, 3, 500)
    rows = []
    for i in range(150):  # a large group whose members differ from each other by up to 40 words
        w = list(base)
        for _ in range(draw.randint(0, 12)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(words(30 + i, i, 800))) for i in range(40)]
    rows += [(3000 + i, " ".join([*words(20, 7), *words(i % 3, i)])) for i in range(12)]
    return rows + [(4000, "a b c d e f g h"), (4001, "a b c d e f g h i"), (4002, "A b  c d e f g\th")]


def test_against_all_pairs(spark):
    for rows in (hard_documents(), near_rows()):
        got = minhash.near_duplicates(frame(spark, rows)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_large_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 40)
    rows = near_rows()
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_min_and_max_are_unbiased():
    draw = np.random.default_rng(2)
    a = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.concatenate([a[:300], draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 300 / 500) < 0.2


def test_components(spark):
    draw = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x != y:
            p, q = sorted((find(x), find(y)))
            parent[q] = p
    assert got == {(x, find(x)) for x in parent}
