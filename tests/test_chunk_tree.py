"""Chunks along the tree of headings against a tree of nodes built document by document."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking


class Node:
    def __init__(self, level, title, up, page):
        self.level, self.title, self.up, self.page, self.lines, self.kids = level, title, up, page, [], []


def tree(lines):
    root = at = Node(0, None, None, None)
    page = None
    for line in lines:
        mark = chunking.re.match(r"^<!-- page:(\d+) -->", line)
        head = chunking.re.match(r"^(#{1,6})\s+(.+)$", line.strip())
        if mark:
            page = int(mark[1])
        if head and not mark:
            while at.up and at.level >= len(head[1]):
                at = at.up
            node = Node(len(head[1]), head[2].strip(), at, page)
            at.kids.append(node)
            at = node
        else:
            at.lines.append(line)
    return root


def walked(node):
    for kid in node.kids:
        yield kid
        yield from walked(kid)


CONTENTS = {"목차", "Contents"}


def brute(lines):
    root, out = tree(lines), []
    nodes = list(walked(root))
    if not nodes:
        return [("(no heading)", None, None, chunking.clean("\n".join(lines)) or "\n".join(lines).strip())]
    if chunking.clean("\n".join(root.lines)):
        out.append(("(preamble)", None, None, chunking.clean("\n".join(root.lines))))
    for node in nodes:
        if node.title in CONTENTS:
            continue
        path, up = [], node
        while up.level:
            path = [up.title, *path] if up.title not in CONTENTS else path
            up = up.up
        parts = chunking.parts_of(chunking.clean("\n".join(node.lines)))
        out += [(node.title, " > ".join(path), f"{i}/{len(parts)} {kind} {node.page}", c) for i, (kind, c) in enumerate(parts, 1)]
    return out


def documents():
    draw = random.Random(12)
    docs = []
    for _ in range(25):
        lines = []
        for i in range(draw.randint(0, 40)):
            kind = draw.random()
            if kind < 0.25:
                lines.append("#" * draw.randint(1, 6) + draw.choice([" Title ", " 목차", " 제1조【x】 "]) .rstrip() + ("" if draw.random() < 0.5 else f" {i}x"))
            elif kind < 0.35:
                lines.append(f"<!-- page:{i // 4 + 1} -->")
            elif kind < 0.5:
                lines.append("| a | b |" if draw.random() < 0.7 else "| one |")
            elif kind < 0.6:
                lines.append(draw.choice(["", "- 3 -", "--", "12 / 30", "####### deep"]))
            else:
                lines.append(" ".join(["word"] * draw.randint(1, 150)) + ".")
        docs.append("\n".join(lines))
    return docs


def test_like_a_tree(spark):
    docs = documents() + ["", "plain text\nonly", "# a\n# b\n", None]
    got = chunking.chunk_markdown(spark.createDataFrame(list(enumerate(docs)), "doc long, text string").withColumn("node", F.lit("x")))
    rows = {}
    for r in got.orderBy("doc", "node", "part").collect():
        has = r.kind is not None
        rows.setdefault(r.doc, []).append((r.heading, r.path, f"{r.part_index}/{r.part_total} {r.kind}" if has else None, r.content))
    for i, doc in enumerate(docs):
        want = [] if doc is None else brute(doc.splitlines() or [""])
        want = [(h, p, k and k.rsplit(" ", 1)[0], c) for h, p, k, c in want]
        assert rows.get(i, []) == want, i


def test_repair_pages_and_tables(spark):
    rows = "\n".join(f"| {i} | {'x' * 90} |" for i in range(40))
    doc = f"intro\n<!-- page:2 -->\n# 보험\n- 제3조(지급) 본문\n<!-- page:3 -->\n{'가나다라. ' * 200}\n<!-- page:5 -->\n{'마바사. ' * 100}\n## 기준으로 합니다.\n### 표\n| n | v |\n|---|---|\n{rows}\n<!-- page:6 -->\n"
    got = chunking.chunk_markdown(spark.createDataFrame([(1, doc)], "doc long, text string")).orderBy("node", "part").collect()
    assert [r.heading for r in got if r.part_index in (None, 1)] == ["(preamble)", "제3조(지급)", "표"]
    clause = [r for r in got if r.heading == "제3조(지급)"]
    assert clause[0].path == "보험 > 제3조(지급)" and clause[0].content.startswith("본문") and clause[-1].content.endswith("기준으로 합니다.")
    assert (clause[0].first_page, clause[-1].last_page) == (2, 5) and all(r.first_page <= r.last_page for r in clause)
    table = [r for r in got if r.kind == "table"]
    assert len(table) > 1 and all(r.content.startswith("| n | v |\n|---|---|\n") and len(r.content) <= chunking.TABLE_MAX for r in table)
    assert (table[-1].first_page, table[-1].last_page) == (5, 6)
    assert sum(r.content.count("x" * 90) for r in table) == 40


@pytest.mark.parametrize("line", ["![image 3]", "a ····· 3", "x…… …", "…… x ………", "- 15 -", "3 -", "3 / 10", "Page 3/10", "PAGE 3 of 10", "--", "가", "a", "  ", "text", "12 -x"])
def test_noise_is_what_the_column_says(spark, line):
    said = spark.createDataFrame([(line,)], "t string").select(tx.is_noise_line(F.col("t"))).first()[0]
    assert said == (line.strip() != "" and chunking.clean("a\n" + line + "\nb") == "a\nb")


def test_quotes_and_dashes(spark):
    odd = "「a」『b』„c‟ «d» ‘e’ ‚f‛ g‐h‑i‒j―k−l﹘m﹣n－o  p​q  \nr  "
    want = unicodedata.normalize("NFKC", odd)
    for old, new in (("「」『』„‟«»", '"'), ("‘’‚‛", "'"), ("‐‑‒–—―−﹘﹣－", "-")):
        want = "".join(new if c in old else c for c in want)
    want = chunking.re.sub(" {2,}", " ", want.replace("​", "").replace(" \n", "\n").replace(" \n", "\n"))
    assert spark.createDataFrame([(odd,)], "t string").select(tx.normalize(F.col("t"))).first()[0] == want
