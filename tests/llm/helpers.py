"""Small documents with the cases that every operator has to stand, and brute-force versions."""

import random

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(n, seed, vocabulary=200):
    draw = random.Random(seed)
    pool = ["".join(random.Random(f"w{i}").choices(LETTERS, k=2 + i % 6)) for i in range(vocabulary)]
    return [draw.choice(pool) for _ in range(n)]


def hard_documents():
    """(doc_id, text): null and empty, short, repeated rows, ties, white space alone, a very long text, odd characters."""
    base = " ".join(words(120, 1))
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, base),
        (2, None),
        (3, ""),
        (4, near),
        (5, base),
        (5, base),
        (6, " \n\t "),
        (7, "one two"),
        (8, "ONE  two"),
        (9, "naïve café \U0001f600 ’ tail " + base[:80]),
        (10, " ".join(words(6000, 2, 900))),
        (None, base),
        (None, None),
        (12, "word " * 400),
        (13, "a\x00b   c d \x1c e"),
    ]


def frame(spark, rows, schema="doc_id long, text string"):
    """With further columns, one of which has a name that operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({"uid": F.lit("x"), "n": F.lit(1), "spans": F.lit("y"), "ids": F.lit(None).cast("string")})


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)
