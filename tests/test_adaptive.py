"""Adaptive chunks of lines against blocks and paths found line by line, and the plan of their query."""

import os
import random
import re

import pytest

from tessera import plans
from tessera.operators import chunking

BLANK = " \t\n\x0b\f\r"
SMALL = "/root/testdata/sf0.001"


def expected(doc, lines):
    """path, kind, content of each part, in order."""
    open_, blocks, before = {}, [], None
    for line in lines:
        bare = (line or "").strip(BLANK)
        head = re.match(r"^(#{1,6})[ \t\n\x0b\f\r]+([^\n\r\x85  ]+)$", bare)
        kind = "table" if bare.startswith("|") and bare.endswith("|") else "text"
        if head:
            level, title = len(head[1]), head[2].strip(BLANK)
            shown = None if title.lower() in ("contents", "목 차") or title.count("·") >= 3 else title
            open_ = {k: v for k, v in open_.items() if k < level} | {level: shown}
        if head or kind != before:
            blocks.append((" > ".join(t for _, t in sorted(open_.items()) if t is not None), kind, []))
        before = kind
        if not head and line is not None:
            blocks[-1][2].append(line)
    out = []
    for path, kind, kept in blocks:
        content = "\n".join(kept).strip(BLANK)
        if content:
            out += [(path, kind, c) for c in (chunking.table_rows(content) if kind == "table" else chunking.paragraphs(content))]
    numbered, seen = [], {}
    for path, kind, content in out:
        seen[path] = seen.get(path, 0) + 1
        numbered.append((doc, path, seen[path], kind, content))
    return [(d, p, i, seen[p], k, c) for d, p, i, k, c in numbered]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_chunks_of_lines(spark, batch):
    draw = random.Random(7)
    kinds = [
        "# A", "## A", " ### B ", "#### contents", "## x ··· 4", "#no heading", "####### seven", "", " ", None, "　", " ", "| a | b |", " |c|\t", "| open", "|",
        "\xa0text\xa0", "Some words. And more. " * 40, "word " * 300, "| " + "cell " * 200 + "|", "plain line", "\x1c", "한글 줄.", "x" * 1200, "x" * 1201,
    ]
    docs = {d: [draw.choice(kinds) for _ in range(draw.randrange(1, 60))] for d in range(60)}
    docs[99] = ["no heading", *["|---|---|", "| " + "y" * 2390 + " |"] * 3, "# A", "# A", *["line " * 9] * 400]
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in chunking.adaptive_chunks(spark.createDataFrame(rows, "doc long, pos long, line string")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(got, key=key) == sorted((r for d, lines in docs.items() for r in expected(d, lines)), key=key)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_lines_are_not_shuffled_or_met_again(spark):
    plan = plans.queries()["d1_adaptive_chunks"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "MergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2  # orders, and the parts at the end
