"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import row_map, sample_bound, table

#: Kinds of the fixed patterns, in the order that breaks ties, and the kind of the model's spans.
KINDS = ("assign", "access", "hex")
MODEL_KIND = "markov"
LETTERS_AND_DIGITS = 62
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
#: Parts of the words that ASSIGN begins with, one in each: a text without any has no match.
HINTS = ("passw", "secret", "token", "api")
#: Characters that runs are made of, and how many a run, or what of it is outside base spans, needs to be judged. Words from LEAST_WORD to below LONG_WORD train the model of ordinary words.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LEAST_RUN, LEAST_WORD, LONG_WORD = 12, 6, 20
#: Documents sampled for the ordinary model, at most about so many, words of theirs at most, and drawn strings of each alphabet for the random ones.
SAMPLE_DOCS, SAMPLE_WORDS, DRAWN = 2000, 40_000, 2000
#: Log-likelihood ratio (nats) at which a run counts as random: a prior of one in a thousand.
THRESHOLD = math.log(1e3)
#: Alphabets in which keys are written; a model each.
ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789ABCDEF", "0123456789abcdef", ALPHABET[:26] + "234567", ALPHABET[:62] + "_-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind as listed; offsets in code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Words that names in code, paths and hosts are made of, whatever the corpus is about.
TECHNICAL = "mail example http https proxy settings usr local lib python config readme backup version default timeout seconds max retry count user name get set by id com org net service request handler factory xml json html text file path index data value key list test main server client application image number type code error alpha beta release".split()


class MarkovRatio:
    """Log-likelihood ratio of first-order Markov models over ALPHABET, one for each kind of random and of ordinary strings; kinds of a side are as likely beforehand."""

    def __init__(self, random_strings: list[list[str]], ordinary_strings: list[list[str]]):
        self.index = {c: i for i, c in enumerate(ALPHABET)}
        self.kinds = len(random_strings)
        #: Log probabilities: after a character (the last row: at the start), of a character, one number for each kind.
        self.logs = [[tuple(x) for x in row] for row in np.stack([self._fit(s) for s in [*random_strings, *ordinary_strings]], axis=-1).tolist()]
        self.ways = math.log(len(ordinary_strings))

    def _fit(self, strings: list[str]) -> np.ndarray:
        n = len(ALPHABET)
        counts = np.full((n + 1, n), 0.5)
        for s in strings:
            before = n
            for c in s:
                at = self.index[c]
                if at >= LETTERS_AND_DIGITS:
                    before = n
                    continue
                counts[before, at] += 1
                before = at
        return np.log(counts / counts.sum(1, keepdims=True))

    def score(self, s: str) -> float:
        """The ratio over letters and digits; after any other character a new part begins, which may be ordinary in a way of its own."""
        steps: list[tuple[float, ...]] = []
        row, begin, common = self.logs[-1], 0, 0.0
        for c in s + ".":
            at = self.index[c]
            if at < LETTERS_AND_DIGITS:
                steps.append(row[at])
                row = self.logs[at]
            elif len(steps) > begin:
                common += _log_sum([sum(kind) for kind in zip(*steps[begin:])][self.kinds :]) - self.ways
                row, begin = self.logs[-1], len(steps)
        if not steps:
            return 0.0
        return _log_sum([sum(kind) for kind in zip(*steps)][: self.kinds]) - math.log(self.kinds) - common


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def drawn(seed: int = 7, count: int = DRAWN, low: int = 12, high: int = 48) -> list[list[str]]:
    """Labelled random strings of each of ALPHABETS."""
    draw = random.Random(seed)
    return [["".join(draw.choices(a, k=draw.randint(low, high))) for _ in range(count)] for a in ALPHABETS]


def numbers(seed: int = 8, count: int = DRAWN) -> list[str]:
    """Labelled ordinary strings that the sample may lack: numbers, dates, versions and addresses."""
    draw = random.Random(seed)
    return [draw.choice(".-/+=_").join("".join(draw.choices("0123456789", k=draw.randint(1, 9))) for _ in range(draw.randint(1, 5))) for _ in range(count)]


def identifiers(words: list[str], seed: int = 9) -> list[str]:
    """Labelled ordinary strings in the ways in which names are put together, from the sample's words."""
    draw = random.Random(seed)
    plain = [w for w in words if w.isalpha()]
    plain += TECHNICAL * (1 + len(plain) // len(TECHNICAL))  # about as many
    end = lambda: str(draw.randint(0, 999)) if draw.random() < 0.2 else ""
    made = []
    for _ in range(SAMPLE_WORDS):
        a, b, c = (draw.choice(plain).lower()[: draw.randint(3, 12)] for _ in range(3))
        made.append(draw.choice((a.upper() + b.upper(), a + b.title() + c.title(), a.title() + b.title(), a + b, f"{a.upper()}_{b.upper()}", f"{a}_{b}", f"{a}.{b}/{c}", a.upper())) + end())
    return made


def pieces(text: str, base: list[tuple[int, int, str]], least: int) -> Iterator[tuple[int, int]]:
    """Runs, and what base spans leave of them, of at least so many characters."""
    for m in RUN.finditer(text):
        a, end = m.span()
        for x, y, _ in base:
            if x < end and a < y:
                if x - a >= least:
                    yield a, x
                a = y
        if end - a >= least:
            yield a, end


def spans(text: str, model: MarkovRatio | None) -> list[tuple[int, int, str, float | None]]:
    """Base spans, and the runs apart from them that the model takes for random."""
    base = base_spans(text)
    out = [(a, b, kind, None) for a, b, kind in base]
    if model is not None:
        for a, b in pieces(text, base, LEAST_RUN):
            score = model.score(text[a:b])
            if score >= THRESHOLD:
                out.append((a, b, MODEL_KIND, score))
        out.sort(key=lambda s: (s[0], (*KINDS, MODEL_KIND).index(s[2])))
    return out


def train(docs: DataFrame) -> MarkovRatio:
    """Models from labelled samples: strings drawn at random, and numbers, identifiers and the words of about SAMPLE_DOCS documents outside base spans.

    The documents are those whose hash of id and text is below a bound that their number sets; of their distinct
    words the SAMPLE_WORDS of least hash are used.
    """
    bound = sample_bound(docs.count(), SAMPLE_DOCS)
    sample = docs.filter((F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))) <= F.lit(bound)).select("text")
    words = row_map(
        sample,
        "word string",
        lambda: lambda rows: (((w,), len(w)) for (text,) in rows if text for w in ordinary(text)),
        pa.schema([("word", pa.string())]),
    )
    found = [row.word for row in words.distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()]
    return MarkovRatio(drawn(), [found, identifiers(found), numbers()])


def ordinary(text: str) -> Iterator[str]:
    """Words outside base spans of less than LONG_WORD characters, as longer ones may be keys."""
    for a, b in pieces(text, base_spans(text), LEAST_WORD):
        if b - a < LONG_WORD:
            yield text[a:b]


def find_secrets(docs: DataFrame, model: MarkovRatio | None) -> DataFrame:
    """Spans of secrets in every whole text.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, spans
    array<struct<start, end, kind, score>>, score being the model's ratio (null for base spans). A null
    or empty text has no spans; repeated rows are scanned each, very long texts whole; an empty table gives none. model None: base spans only.
    """

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                found = spans(text, model) if text else []
                yield (doc_id, [{"start": a, "end": b, "kind": kind, "score": score} for a, b, kind, score in found]), 40 * len(found)

        return step

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    return row_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id bigint, spans array<struct<start: bigint, end: bigint, kind: string, score: double>>", start, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(docs))
    written = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s.kind != MODEL_KIND)).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
