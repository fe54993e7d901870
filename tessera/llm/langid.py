"""Language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, kept, row_map, sample_bound, table

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Labelled documents of each language that the models are fitted on, at most about so many.
SAMPLE_DOCS = 600
#: Rounds of expectation maximisation, and what a piece without expected count weighs.
ROUNDS, SMOOTH = 3, 0.02
#: Words whose scores each worker keeps, the first that it meets; longer ones than KEPT_CHARS are not kept.
KEPT, KEPT_CHARS = 300_000, 40
UNDETERMINED = "und"


def vocabulary(path: str) -> set[str]:
    """Pieces of a fixed public vocabulary that words can be made of."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(p := model.id_to_piece(i).lower()) > 0}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def prefixes(pieces) -> set[str]:
    return {p[:i] for p in pieces for i in range(1, len(p) + 1)}


def fit(counts: dict[str, int], pieces: set[str]) -> dict[str, float]:
    """Piece probabilities of one language by forward-backward over the segmentations of its words.

    A character that is no piece counts as one. Probabilities hold a share for pieces never used.
    """
    starts = prefixes(pieces)
    prob: dict[str, float] = {}
    default = 1.0 / max(1, len(pieces))
    for _ in range(ROUNDS):
        expected: dict[str, float] = {}
        get = prob.get
        for word, n in counts.items():
            s = START + word
            m = len(s)
            edges = []
            ahead = [0.0] * (m + 1)
            ahead[0] = 1.0
            scale = [1.0] * (m + 1)
            for i in range(m):
                a = ahead[i]
                if a == 0.0:
                    continue
                for j in range(i + 1, m + 1):
                    piece = s[i:j]
                    known = piece in starts
                    if j == i + 1 or (known and piece in pieces):
                        p = get(piece, default)
                        edges.append((i, j, piece, p))
                        ahead[j] += a * p
                    if not known:
                        break
                if m > 60 and 0 < ahead[i + 1] < 1e-100:  # long words: the same factor on all that lies ahead
                    for j in range(i + 1, m + 1):
                        ahead[j] *= 1e100
                    scale[i + 1] = 1e100
            if m > 60 or ahead[m] <= 0.0:
                continue  # too long to be a word: of no use to the fit
            back = [0.0] * (m + 1)
            back[m] = 1.0
            for i, j, _, p in reversed(edges):
                back[i] += p * back[j]
            share = n / ahead[m]
            for i, j, piece, p in edges:
                expected[piece] = expected.get(piece, 0.0) + ahead[i] * p * back[j] * share
        total = sum(expected.values()) + SMOOTH * (len(pieces) + 1)
        prob = {piece: (x + SMOOTH) / total for piece, x in expected.items()}
        default = SMOOTH / total
    return prob | {"": default}


class Models:
    """Piece probabilities of all languages, and the forward sums of words."""

    def __init__(self, langs: list[str], tables: list[dict[str, float]], pieces: set[str]):
        self.langs = langs
        floor = [t[""] for t in tables]
        used = set().union(*tables) - {""} if tables else set()
        #: Each usable piece's probabilities, () for a mere beginning of one.
        self.table: dict[str, tuple[float, ...]] = {p: () for p in prefixes(pieces | used)}
        for piece in pieces | used:
            self.table[piece] = tuple(t.get(piece, f) for t, f in zip(tables, floor))
        self.floor = tuple(floor)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(langs)))

    def forward(self, word: str) -> list[float]:
        """Log probability of a word under each language, summed over all its segmentations."""
        s = START + word
        m, get, floor = len(s), self.table.get, self.floor
        ahead: list = [None] * (m + 1)
        ahead[0] = [1.0] * len(floor)
        log_scale = 0.0
        for i in range(m):
            a = ahead[i]
            ahead[i] = None
            if max(a) < 1e-60:
                up = 1.0 / max(a)
                log_scale -= math.log(up)
                a = [x * up for x in a]
                for j in range(i + 1, m + 1):
                    if ahead[j] is None:
                        break
                    ahead[j] = [x * up for x in ahead[j]]
            for j in range(i + 1, m + 1):
                known = p = get(s[i:j])
                if not p:
                    if j == i + 1:
                        p = floor  # a character that is no piece: so every position can be reached
                    elif known is None:
                        break
                    else:
                        continue
                b = ahead[j]
                ahead[j] = [x * y for x, y in zip(a, p)] if b is None else [z + x * y for x, y, z in zip(a, p, b)]
                if known is None:
                    break
        return [math.log(x) + log_scale if x > 0 else log_scale - 700.0 for x in ahead[m]]

    def text(self, text: str) -> np.ndarray | None:
        """Log probability of a text's words under each language; None without a letter."""
        words = words_of(text)
        if not words or not has_letter(text):
            return None
        rows = self.rows
        at = np.fromiter(map(rows.get, words, [-1] * len(words)), np.int64, len(words))
        total = np.zeros(len(self.langs))
        new = np.flatnonzero(at < 0)
        for i in new.tolist():
            word = words[i]
            row = rows.get(word)
            if row is None:
                score = self.forward(word)
                if len(word) > KEPT_CHARS or len(rows) >= KEPT:
                    total += score
                    continue
                row = rows[word] = len(rows)
                if row >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[row] = score
            total += self.scores[row]
        return total + self.scores[at[at >= 0]].sum(0)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its share of the probability, all languages being as likely beforehand."""
        total = self.text(text) if text and self.langs else None
        if total is None:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())


def train(docs: DataFrame, path: str) -> Models:
    """Models of every language among the given labelled rows (text, lang), null labels aside.

    About SAMPLE_DOCS different texts of each language are used, those whose hash is below a bound that their
    number sets, each as often as it is labelled so; each language is fitted in a task of its own, whose input
    that bound holds. Repeated rows count each, very long texts whole. An empty table gives no models.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Models([], [], set())
    bounds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample_bound(n, SAMPLE_DOCS))])
    sample = labelled.filter(F.col("h") <= bounds[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"), F.count("*").alias("n"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for text, n in zip(rows["text"], rows["n"]):
            for word, k in Counter(words_of(text)).items():
                counts[word] += k * n
        prob = fit(counts, vocabulary(path))
        return pd.DataFrame({"lang": key[0], "piece": list(prob), "prob": list(prob.values())})

    fitted: dict[str, dict[str, float]] = {}
    for row in sample.groupBy("lang").applyInPandas(one, "lang string, piece string, prob double").collect():
        fitted.setdefault(row.lang, {})[row.piece] = row.prob
    langs = sorted(fitted)
    return Models(langs, [fitted[lang] for lang in langs], vocabulary(path))


def _copy(shared) -> Models:
    """A worker's copy of shared models, which keeps the words it has met."""
    own = Models.__new__(Models)
    own.langs, own.table, own.floor = shared.value
    own.rows, own.scores = {}, np.zeros((1024, len(own.langs)))
    return own


def _on_workers(spark: SparkSession, models: Models) -> Callable[[], Models]:
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((models.langs, models.table, models.floor))
    return lambda: kept(name, lambda: _copy(shared))


def language(spark: SparkSession, models: Models, text: Column) -> Column:
    """lang_pred and score of a text column, as identify() gives them."""
    own = _on_workers(spark, models)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        models = own()
        return pd.DataFrame([models.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Language of every whole text.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, lang_pred, score
    (posterior, 0 to 1). A text that is null or has no letter gives `und` and 0, as all do where no
    language was learned. Ties go to the language that sorts first. An empty table gives none.
    """
    own = _on_workers(docs.sparkSession, models)

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        models = own()

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                yield (doc_id, *models.predict(text)), 40

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return row_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id bigint, lang_pred string, score double", start, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    models = train(docs.filter(~out), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, models).select("doc_id", out.alias("held_out"), "lang_pred", "score")
