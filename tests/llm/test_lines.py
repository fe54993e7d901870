import random

from pyspark.sql import functions as F

from tests.llm.helpers import empty, hard_documents
from tessera.llm import linededup

LONG = "this is quite a long line of text that comes again"
END = (1 << 63) - 1


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows):
    lines = []
    for d, t in rows:
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            lines.append(((END if d is None else d, pos), line.strip(" \t\r")))
    first = {}
    for at, f in lines:
        if f:
            first[f] = min(at, first.get(f, at))
    dropped = {f for f, at in first.items() if len(f) >= linededup.MIN_CHARS and any(a < at and len(g) >= linededup.MIN_CHARS and near(f, g) for g, a in first.items())}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        parts = t.split("\n")
        keep = [p for pos, p in enumerate(parts) if (f := p.strip(" \t\r")) not in first or (f not in dropped and first[f] == (END if d is None else d, pos))]
        out.append((d, "\n".join(keep), len(parts), len(parts) - len(keep)))
    return sorted(out, key=str)


def variants():
    rows = [(1, LONG + "\nshort\n" + LONG), (2, "short\n  " + LONG + "\r"), (3, LONG[:20] + "X" + LONG[21:]), (4, LONG[1:]), (5, LONG + "y"), (6, LONG[:30] + LONG[32:])]
    very = "".join(chr(97 + i * 7 % 26) for i in range(300))
    rows += [(10, very), (11, very[:64] + very[65:]), (12, very[:150] + "é" + very[150:]), (13, very[:-1]), (14, very[:63] + "Z" + very[64:]), (15, very[:127] + "😀" + very[127:]), (16, very + "ab")]
    rows += [(30 + i, f"counter line number {i} of the many lines") for i in range(9)]
    return rows + [(50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (51, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (52, "\n\n"), (53, "x" * 25), (54, "x" * 24)]


def test_against_all_pairs(spark):
    for rows in (variants(), hard_documents()):
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit(1), "h1": F.lit("z"), "n": F.lit(2.5)})
        got = linededup.dedup_lines(frame)
        assert got.columns == ["doc_id", "text", "pos", "h1", "n", "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows)
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_long_lines(spark):
    """Lines of 100,000 characters one edit apart, at places around the ends of blocks, in time that grows with their length."""
    draw = random.Random(1)
    base = "".join(draw.choices("abcdefé", k=100_000))
    rows = [(1, base), (2, base[:63] + base[64:]), (3, base[:50_048] + "x" + base[50_048:]), (4, base[:-1] + "z"), (5, base[:128] + "zz" + base[128:])]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_pipeline_takes_out_short_repeats(spark):
    import corpus_pipeline

    rows = [(1, "short\n\n" + LONG + "\n \nshort"), (2, "  short\r\nshorx\n\n" + LONG + "y"), (3, "short"), (4, None), (5, "other\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    first, second = "short\n\n" + LONG + "\n ", "shorx\n"
    assert got == {1: (first, len(first)), 2: (second, len(second)), 4: (None, None), 5: ("other\n\n", 7)}
