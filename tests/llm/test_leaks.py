import random
from collections import Counter

import numpy as np

from tests.llm.helpers import empty, frame, hard_documents, words
from tessera.llm import decontam
from tessera.llm import shingles as shingles_of


def shingles(w, width):
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for item, x in items:
            v = (x or "").encode().lower().split()
            if not v or len(v) > len(w):
                continue
            width = min(5, len(v))
            k = Counter(shingles(v, width))
            for s in range(len(w) - len(v) + 1):
                c = Counter(shingles(w[s : s + len(v)], width))
                if sum((c & k).values()) >= 0.75 * sum((c | k).values()):
                    out.add((d, item))
                    break
    return out


ITEMS = [(1, " ".join(words(30, 50))), (2, " ".join(words(18, 51))), (3, None), (4, ""), (5, "zig zag"), (6, "word " * 30), (7, " ".join(words(30, 50)))]


def test_against_all_windows(spark):
    item = ITEMS[0][1].split()
    edited = item[:10] + ["new"] + item[11:]
    far = [w if i % 4 else "other" for i, w in enumerate(item)]
    docs = [*hard_documents(), (20, " ".join(words(50, 9) + item + words(40, 10))), (21, " ".join(words(5, 9) + edited).upper()), (22, " ".join(far)), (23, "a zig   ZAG b"), (24, " ".join(item[:20])), (25, " ".join(item * 3))]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_leaks(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, ITEMS)
    best = next(r for r in got if (r.doc_id, r.item_id) == (20, 1))
    assert (best.first_word, best.end_word, best.similarity) == (50, 80, 1.0)
    flagged = decontam.clean(frame(spark, docs), bench).collect()
    assert sorted((str(r.doc_id) for r in flagged)) == sorted(str(d) for d, _ in docs if d not in {d for d, _ in brute(docs, ITEMS)})
    assert decontam.find_leaks(empty(spark), bench).count() == 0
    assert decontam.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 100)
    docs = [(20, " ".join(words(50, 9)) + " " + ITEMS[1][1])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, docs), bench).collect()} == {(20, 2)}
    assert {r.doc_id for r in decontam.clean(frame(spark, [*docs, (21, "a b c")]), bench).collect()} == {21}


def test_fingerprints_lose_no_near_window_in_hundreds():
    """Planted items of a similarity from 0.75 on, each found by brute force: the fingerprints' recall is at least 0.99."""
    draw = random.Random(1)
    pool = words(2000, 1, 800)
    missed = total = 0
    for n in range(900):
        size = 16 + n % 44
        item = [draw.choice(pool) for _ in range(size)]
        text = list(item)
        for at in draw.sample(range(size), 1 + (n % 3 if size > 40 else n % 2 if size > 25 else 0)):
            text[at] = "other"
        text = [draw.choice(pool) for _ in range(30)] + text + [draw.choice(pool) for _ in range(20)]
        want = brute([(1, " ".join(text))], [(1, " ".join(item))])
        found = decontam.Index([(1, " ".join(item).encode())]).matches([" ".join(text).encode()])[0]
        total += len(want)
        missed += len(want) - len(found)
    assert total > 150 and missed <= total / 100


def test_tables_name_all_fingerprints_within_the_radius():
    draw = np.random.default_rng(5)
    items = draw.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.array([[np.uint64(sum(1 << int(b) for b in draw.choice(64, n, replace=False))) for n in range(decontam.RADIUS + 3)] for _ in items])
    prints = (items[:, None] ^ flips).ravel()
    own = decontam.Class(20, list(range(20)), items, np.full(20, 20))
    row, item = own.near(prints, lambda at: np.ones(len(at), bool))
    distance = np.bitwise_count(prints[:, None] ^ items[None])
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontam.RADIUS))))


def test_word_hashes():
    text = b" Alpha beta\x0balpha \tBETA " + b"x" * 70000 + b" " + b" gamma" * 60000
    hashes, starts = shingles_of.word_hashes(text)
    words_in = text.lower().split()
    assert len(hashes) == len(words_in) == len(starts) and [text.lower()[s : s + 3] for s in starts[:4].tolist()] == [w[:3] for w in words_in[:4]]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words_in, hashes.tolist())) and len(set(seen.values())) == len(seen)
    assert len(shingles_of.word_hashes(b"")[0]) == 0


def test_texts_shorter_than_the_item(spark):
    item = words(60, 70)
    docs = [(1, " ".join(item[:58])), (2, " ".join(item[10:])), (3, " ".join(item[:46])), (4, " ".join(item[:45])), (5, " ".join(item[:4])), (6, item[0]), (7, " ".join(item[1:30] + ["new"] + item[31:]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "zig zag")], "item_id long, text string")
    got = decontam.find_leaks(frame(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.first_word, r.end_word, round(r.similarity, 6)) for r in got) == [(1, 0, 58, round(54 / 56, 6)), (2, 0, 50, round(46 / 56, 6)), (3, 0, 46, 0.75), (7, 0, 59, round(50 / 61, 6))]
    assert {r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()} == {4, 5, 6}
