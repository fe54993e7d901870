"""Joins without pairs of a group: substrings by runs of characters, and what is nearest by one sort."""

import random

from pyspark.sql import functions as F

from tessera.operators import ingest, quality, structure, substrings


def test_containing(spark):
    draw = random.Random(6)
    some = lambda n: "".join(draw.choices("ab\n é", k=n))
    texts = [(k, i, some(draw.randint(0, 60))) for k in ("x", "y") for i in range(30)] + [("x", 99, None), ("y", 98, "aaaaaaaaaa"), ("z", 1, "abc"), ("x", 97, "\U0001f600abcdefgh\U0001f600")]
    needles = []
    for k, i, t in texts:
        if t:
            at = draw.randrange(len(t))
            needles.append((k, i, t[at : at + draw.randint(1, 20)]))
    needles += [("x", 200, None), ("x", 201, ""), ("y", 202, "aaaaaaaaa"), ("q", 203, "a"), ("x", 204, "\U0001f600"), ("y", 205, "a.b.*c(")]
    got = substrings.containing(spark.createDataFrame(texts, "k string, tid int, text string"), spark.createDataFrame(needles, "k string, nid int, needle string"), ["k"])
    want = sorted((k, i, j) for k, i, t in texts for k2, j, n in needles if k == k2 and t is not None and n is not None and n in t)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "run#" in got._jdf.queryExecution().executedPlan().toString()


def test_anchors_and_names(spark):
    hits = spark.createDataFrame([(1, 1, "Nothing"), (1, 2, "The  An chor one"), (1, 3, "anchor"), (2, 1, "x"), (3, 1, "y")], "query_id int, rank int, content string")
    anchors = spark.createDataFrame([(1, "anchor"), (1, "zzz"), (2, "q"), (9, "x")], "query_id int, anchor string")
    assert sorted(tuple(r) for r in quality.anchor_ranks(hits, anchors).collect()) == [(1, 2), (2, None)]
    wanted = spark.createDataFrame([("k", 1, "alpha beta"), ("k", 2, "beta"), ("k", 3, "gamma"), ("n", 4, "alpha beta"), ("k", 5, "beta")], "k string, id int, name string")
    rules = spark.createDataFrame([("k", 3, "beta"), ("k", 1, "gamma delta"), ("k", 2, "alpha")], "k string, ord int, name string")
    assert sorted(tuple(r)[1:] for r in quality.first_either_way(wanted, rules, "k").collect()) == [(1, "alpha beta", 2, "alpha"), (2, "beta", 3, "beta"), (3, "gamma", 1, "gamma delta"), (4, "alpha beta", None, None), (5, "beta", 3, "beta")]


def test_merged_chunks(spark):
    draw = random.Random(8)
    chunks = [(d, s, draw.choice(["h1", "h2", None]), draw.choice([None, 1, 2, 3, 5, 9])) for d in range(6) for s in range(1, 9)]
    seen = [(d, 100 + i, draw.choice(["h1", "hx", None, None]), draw.choice([None, 1, 2, 4, 9])) for i, d in enumerate([0, 0, 1, 2, 2, 3, 4, 5, 5, 5])]
    got = structure.merge_recognised(spark.createDataFrame(chunks, "doc int, seq int, heading_path string, start_page int"), spark.createDataFrame(seen, "doc int, id int, heading_path string, start_page int"))
    want = []
    for d in range(6):
        own = [(float(s), False, s, h, p or 0) for e, s, h, p in chunks if e == d]
        for e, i, h, p in seen:
            if e == d:
                after = [s for s, _, _, g, _ in own if h and g == h]
                later = [s for s, _, _, _, q in own if q > (p or 0)]
                at = (max(after) if after else 8) + 0.5 if h else min(later) - 0.5 if later else 8.5
                want.append((d, at, True, i))
        want += [(d, *x[:3]) for x in own]
    want.sort()
    assert [(r.doc, r.seq, r.recognised) for r in got.orderBy("doc", "new_seq").collect()] == [(d, i, r) for d, _, r, i in want]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "page > " not in plan.split("Join")[0]


def test_headings_of_contracts(spark):
    far = "x" * 500
    lines = ["# 보통약관", "제1조(목적) a", "제2조(범위) b", "# 첫 특별약관", "plain 특별약관", "제1조(목적) c", "# 먼 특별약관", far, "제1조(목적) d"]
    frame = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "doc int, pos int, line string")
    got = ingest.contracts(frame, structure.clauses(frame)).orderBy("run").collect()
    assert [(r.run, r.heading) for r in got] == [(0, "보통약관"), (1, "첫 특별약관"), (2, "")]


def test_blocks_of_one_column(spark):
    lines = ["| a |", "|---|", "text", "| a | b |", "| c |", "", "|"]
    frame = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "doc int, pos int, line string")
    assert sorted((r.segment, r.junk) for r in structure.junk_tables(frame).collect()) == [(0, True), (2, False), (4, True)]
    assert structure.junk_tables(frame.filter(F.col("line") == "none")).count() == 0


def test_anchors_by_ranks_and_marks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIRST", 2)
    monkeypatch.setattr(substrings, "MARKS", 2)
    texts = [(q, r, f"chunk {q} of rank {r} here") for q in (1, 2, 3, 4) for r in range(1, 40)] + [(5, 1, None), (6, 3, "no anchor of it")]
    hits = spark.createDataFrame(texts, "query_id int, rank int, content string")
    anchors = spark.createDataFrame([(1, "rank 37"), (1, "of rank 9"), (2, "1 of rank 3"), (3, "3 of rank 1"), (4, "k 4 o"), (5, "x"), (7, "y")], "query_id int, anchor string")
    assert sorted(tuple(r) for r in quality.anchor_ranks(hits, anchors).collect()) == [(1, 9), (2, None), (3, 1), (4, 1), (5, None)]


def test_only_runs_of_needles_are_shuffled(spark):
    texts = spark.createDataFrame([("k", i, "abcdefghijkl" * 3) for i in range(9)], "k string, tid int, text string")
    needles = spark.createDataFrame([("k", 1, "cdefghijk")], "k string, nid int, needle string")
    found = substrings.containing(texts, needles, ["k"])
    assert found.count() == 9
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert any("BroadcastHashJoin" in line and "run#" in line and "LeftSemi" in line for line in plan.splitlines())
