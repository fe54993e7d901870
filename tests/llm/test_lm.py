import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.helpers import empty, frame, hard_documents, words
from tessera.llm import lm


def scored(spark, rows, training):
    counts = lm.count_words(frame(spark, training) if training else empty(spark))
    head = lm.head_of(counts, size=40, own=15)
    model = lm.fit(frame(spark, training) if training else empty(spark), head)
    return head, model, lm.score(frame(spark, rows), counts, head, model).collect()


def test_unigram_base_and_counts(spark):
    rows = hard_documents()
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    _, _, got = scored(spark, rows, training)
    c = Counter()
    for _, t in training:
        c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((d or -1, len(tokens), sum(c[x] > 0 for x in tokens), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one_and_learn_the_order(spark):
    chain = ["alpha beta gamma delta " * 30] * 20
    rows = [(i, t) for i, t in enumerate(chain)]
    head, model, got = scored(spark, rows, rows)
    x = np.arange(head.items)
    sums = model.log_sums(x, x)
    s = (model.r[x] @ model.c1 + model.r[x] @ model.c2) @ model.r[:-1].T + model.b
    assert np.allclose(np.exp(s - sums[:, None]).sum(1), 1, atol=1e-4)
    assert all(r.score > r.base_score + 10 for r in got)


def test_nothing_to_learn_from(spark):
    _, _, got = scored(spark, [(1, "a b"), (2, None)], [])
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    head, _, got = scored(spark, [], [(1, " ".join(words(50, 1)))])
    assert got == [] and head.tokens == 51


def test_words_beyond_the_own_items_are_learned(spark):
    follow = {f"left{i}": f"right{i}" for i in range(200)}
    pairs = [w for x in words(12000, 3, 200) for w in [f"left{zlib.crc32(x.encode()) % 200}"]]
    text = " ".join(f"{w} {follow[w]}" for w in pairs)
    rows = [(i, text[at : at + 4000]) for i, at in enumerate(range(0, len(text), 4000))] * 8
    for size in (600, 40):
        counts = lm.count_words(frame(spark, rows))
        head = lm.head_of(counts, size=size, own=15)
        assert head.items - head.own >= math.sqrt(head.distinct)
        model = lm.fit(frame(spark, rows), head)
        right = " ".join(f"{w} {follow[w]}" for w in pairs[:200])
        wrong = " ".join(f"{w} {follow[v]}" for w, v in zip(pairs[:200], pairs[7:207]))
        got = {r.doc_id: r.score for r in lm.score(frame(spark, [(1, right), (2, wrong)]), counts, head, model).collect()}
        assert got[1] > got[2] + 5, size


def brute(model, head, counts, text):
    """log10 probability of a text in doubles, each context normalised by a plain sum over all items."""
    tokens = [*(text or "").encode().lower().split(), lm.END]
    r, c1, c2, b = (x.astype(float) for x in model.arrays())

    def item(w):
        at = head.place.get(w, -1)
        return at if 0 <= at < head.own else head.own + head.group(w)

    y = x = head.items
    total = 0.0
    for w in tokens:
        i = item(w)
        s = (r[x] @ c1 + r[y] @ c2) @ r[:-1].T + b
        total += (s[i] - np.log(np.exp(s).sum())) / np.log(10)
        if i >= head.own:
            total += math.log10(counts.get(w, 0) + 1) - head.group_log[i - head.own]
        y, x = x, i
    return total


def test_scores_are_the_model_s_probabilities(spark):
    rows = hard_documents()
    counts = lm.count_words(frame(spark, rows[:8]))
    for size in (40, 5):
        head = lm.head_of(counts, size=size, own=4)
        model = lm.fit(frame(spark, rows[:8]), head)
        known = {bytes(r.word): r.n for r in counts.collect()}
        got = sorted((r.doc_id or -1, round(r.score / max(1, r.n_tokens), 4)) for r in lm.score(frame(spark, rows), counts, head, model).collect())
        want = sorted((d or -1, round(brute(model, head, known, t) / (len((t or "").encode().split()) + 1), 4)) for d, t in rows)
        assert np.allclose([x for _, x in got], [x for _, x in want], atol=2e-4) and [x for x, _ in got] == [x for x, _ in want]


def test_words_of_all_items_sum_to_one(spark):
    rows = [(1, " ".join(words(6000, 2, 900)))]
    counts = lm.count_words(frame(spark, rows))
    head = lm.head_of(counts, size=80, own=15)
    known = {bytes(r.word): r.n for r in counts.collect()}
    share = np.zeros(head.items - head.own)
    for w, n in known.items():
        if not 0 <= head.place.get(w, -1) < head.own:
            share[head.group(w)] += (n + 1) / 10 ** head.group_log[head.group(w)]
    assert np.allclose(share + 10.0**-head.group_log, 1)  # with one part for words never seen
    assert abs(np.exp(head.item_log).sum() - 1) < 1e-9


def test_better_than_the_base_however_the_rows_are_dealt(spark):
    """Held-out rows of a corpus in which words follow each other: at least 0.05 a token better than the base, and the same score from 1 and from 16 partitions."""
    pool = words(600, 4, 150)
    draw = np.random.default_rng(3)
    rows = []
    for i in range(240):
        at = draw.integers(0, 599, 40)
        rows.append((i, " ".join(w for a in at for w in (pool[a], pool[a + 1]))))
    training, out = rows[:200], rows[200:]
    found = []
    for n in (1, 16):
        docs = frame(spark, training).repartition(n)
        counts = lm.count_words(docs)
        head = lm.head_of(counts)
        got = lm.score(frame(spark, out).repartition(n), counts, head, lm.fit(docs, head)).collect()
        tokens = sum(r.n_tokens for r in got)
        assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.05
        found.append(sum(r.score for r in got) / tokens)
    assert abs(found[0] - found[1]) < 1e-3


def test_query(spark, tmp_path):
    rows = hard_documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op9_lm_score(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter()
    for d, t in rows:
        if not out[d]:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((d or -1, out[d], len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    got = got.collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def trained(spark, n=300):
    rows = [(i, " ".join(words(n, 6 + i, 120))) for i in range(4)]
    head = lm.head_of(lm.count_words(frame(spark, rows)), size=60, own=15)
    return rows, head, lm.fit(frame(spark, rows), head)


def test_sums_of_all_pairs_are_those_taken_singly(spark):
    _, head, model = trained(spark)
    items = np.random.default_rng(1).permutation(head.items + 1)
    i, j = np.indices((len(items), len(items))).reshape(2, -1)
    for _ in range(2):  # the second: exponentials beyond the numbers' range
        got, want = model.table(items)[i, j], model.log_sums(items[j], items[i])
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-5, atol=2e-4)
        model.r *= np.float32(12)


def test_frequent_contexts_are_summed_once_in_a_model_larger_than_the_table(spark, monkeypatch):
    """A worker keeps the sums of frequent contexts however many items there are, and scores stay the model's."""
    rows, head, model = trained(spark)
    monkeypatch.setattr(lm, "TABLE", 100)
    assert (head.items + 1) ** 2 > lm.TABLE
    counts = lm.count_words(frame(spark, rows))
    known = {bytes(r.word): r.n for r in counts.collect()}
    for r in lm.score(frame(spark, rows), counts, head, model).collect():
        assert abs(r.score - brute(model, head, known, dict(rows)[r.doc_id])) < 2e-4 * r.n_tokens
    frequent = np.concatenate([[head.items], np.argsort(-head.item_log)])[:10]
    y, x = np.random.default_rng(2).integers(0, head.items + 1, (2, 500))
    singly = []
    monkeypatch.setattr(lm.LogBilinear, "log_sums", lambda self, x, y, take=lm.LogBilinear.log_sums: singly.extend(zip(y.tolist(), x.tolist())) or take(self, x, y))
    lm._kept_sums(model, "test of kept sums", frequent, y, x)
    held = set(frequent.tolist())
    assert sorted(singly) == sorted({(a, b) for a, b in zip(y.tolist(), x.tolist()) if not {a, b} <= held})


def test_words_of_odd_bytes():
    texts = [b"", b" ", b"\t A\x0bb\x0c\r\n", bytes(range(256)), "Ä É ß Z".encode(), b"\xff\xfe A\x85b", b"x" * 70000 + b" Y", b"", b"a  b"]
    texts += [bytes([a, 65, b]) for a in range(256) for b in (32, 133)]
    column = pa.array([b"before", *texts], pa.binary()).slice(1)
    sizes, got = lm.words_of(column)
    want = [t.lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and got.to_pylist() == [w for ws in want for w in ws]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for most in (1, 300, 1 << 20):
        parts = [p.column("text").to_pylist() for p in lm.slices(iter([batch]), "text", most)]
        assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= most for p in parts)
