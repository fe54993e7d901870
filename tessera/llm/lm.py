"""Language-model scoring: word counts over all training texts, and a log-bilinear model trained by noise-contrastive estimation.

The model predicts an item from the two before it: q = r(c1) C1 + r(c2) C2, and the score of item w is
q . r(w) + b(w). Items are the most frequent training words, the end of a text, and groups of all other words
by their last two bytes (and, once these do not suffice, by a hash of the word). The number of items grows as
the square root of the number of distinct words, so what the model learns grows with the corpus. A word has
its share of its group's training tokens, with one more part for words never seen. Sums of exponentials
over all items, by batched matrix products, normalise each context.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, kept, row_map, settle, table, text_bytes

#: Stands for the end of a text among tokens: white space, so no word is the same.
END = b" "
#: Words whose counts every worker holds, at most; the others are joined. Words that are items of their own, at least; groups by the last bytes, at most; the model's width.
HEAD, OWN, ENDINGS, WIDTH = 150_000, 1023, 512, 24
#: Noise items for each minibatch, contexts in one, learning rate, and rounds of training.
NOISE, BATCH, RATE, ROUNDS = 32, 2048, 0.06, 2
#: Training tokens of a part, about, and those that a part is trained on at least in a round, in up to EPOCHS repeats.
PART_TOKENS, LEAST_TOKENS, EPOCHS = 1_500_000, 600_000, 10
#: Tokens scored at once, bytes of texts taken into words at once, about; pairs of context items whose sums a worker keeps in a table.
CHUNK, SLICE_BYTES, TABLE = 400_000, 4 << 20, 1 << 24


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of batches, as many at once as have at most so many bytes in a column of bytes; one row at least."""
    for batch in batches:
        edges = _edges(batch.column(name)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _edges(column: pa.Array) -> np.ndarray:
    """Where each value of a column of bytes begins, and the end of the last."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """The same bytes under another type, unchecked."""
    _, edges, held = column.buffers()
    return pa.Array.from_buffers(kind, len(column), [None, edges, held or pa.py_buffer(b"")], offset=column.offset)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text in UTF-8 has, without the end, and the words of all one after the other, A-Z in lower case."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(_as(texts, pa.string())))
    words = _as(split.flatten(), pa.binary())
    some = np.diff(_edges(words)) > 0  # white space at a text's ends gives empty strings
    edges = split.offsets.to_numpy()
    sizes = np.diff(np.concatenate([[0], np.cumsum(some)])[edges - edges[0]])
    return sizes, words if some.all() else words.filter(pa.array(some))


def count_words(docs: DataFrame) -> DataFrame:
    """word binary, n long over all the given texts, the end of each being the token END. Each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            met = pc.value_counts(words_of(part.column("text"))[1])
            yield pa.RecordBatch.from_arrays([met.field("values"), met.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([part.num_rows], pa.int64())], ["word", "n"])

    return docs.select(text_bytes().alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def group_of(word: bytes, endings: int, splits: int) -> int:
    return zlib.crc32(word[-2:]) % endings * splits + zlib.crc32(word) % splits


@dataclass
class Head:
    """The frequent words, items, and the totals of the corpus. Ids of items: own words by falling count after the end, groups, and the beginning as context alone."""

    place: dict[bytes, int]
    log_count: np.ndarray  # log10(count + 1) by place
    tokens: int
    distinct: int
    least: int  # words of this count and more are all in place
    item: np.ndarray  # item of each word in place
    own: int  # words in place that are items of their own
    endings: int
    splits: int
    item_log: np.ndarray  # natural log of the items' shares of the training tokens
    group_log: np.ndarray  # log10 of the parts that each group is dealt into

    @property
    def items(self) -> int:
        return len(self.item_log)

    def group(self, word: bytes) -> int:
        return group_of(word, self.endings, self.splits)

    def ids(self, places: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Items of tokens from their places; those without one (-1) have their groups given in turn."""
        ids = self.item[places]
        ids[places < 0] = self.own + groups
        return ids


def head_of(counts: DataFrame, size: int = HEAD, own: int = OWN) -> Head:
    """The most frequent words, as many whole counts as fit into size; counts are grouped before they reach the driver."""
    by = counts.groupBy((F.floor(F.log2("n") * 16)).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.sum("n").alias("tokens")).orderBy(F.desc("step")).collect()
    distinct, tokens = sum(r.words for r in by), sum(r.tokens for r in by)
    least, words = 1 << 62, 0
    for r in by:
        if words + r.words > size:
            break
        words, least = words + r.words, r.least
    rows = sorted(counts.filter((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect(), key=lambda r: (bytes(r.word) != END, -r.n, bytes(r.word)))
    place = {bytes(r.word): i for i, r in enumerate(rows)}  # the end is an item in any case, the first
    n = np.array([r.n for r in rows], np.float64)
    root = int(np.ceil(np.sqrt(distinct)))
    own = min(len(rows), max(own, root))
    endings = max(1, min(ENDINGS, root))
    splits = max(1, -(-root // endings))
    parts = np.ones(endings * splits)
    item = np.array([*range(own), *(own + group_of(word, endings, splits) for word in list(place)[own:]), 0], np.int64)
    np.add.at(parts, item[own:-1] - own, n[own:] + 1)
    group = F.crc32(F.substring("word", -2, 2)) % endings * splits + F.crc32("word") % splits
    for r in _tail(counts, least).groupBy(group.alias("group")).agg(F.sum(F.col("n") + 1).alias("parts")).collect():
        parts[r.group] += r.parts
    share = np.concatenate([n[:own] + 1, parts])
    return Head(place, np.log10(n + 1), tokens, distinct, least, item, own, endings, splits, np.log(share / share.sum()), np.log10(parts))


def _tail(counts: DataFrame, least: int) -> DataFrame:
    """Counts of the words that are not in the head."""
    return counts.filter((F.col("n") < least) & (F.col("word") != F.lit(END)))


@dataclass
class LogBilinear:
    r: np.ndarray  # items and the beginning, each WIDTH wide
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @staticmethod
    def begin(head: Head, seed: int = 11) -> LogBilinear:
        draw = np.random.default_rng(seed)
        r, c1, c2 = (draw.standard_normal(x) for x in ((head.items + 1, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH)))
        return LogBilinear(*(x.astype(np.float32) for x in (r * 0.2, c1 * 0.1 + np.eye(WIDTH) * 0.1, c2 * 0.1 + np.eye(WIDTH) * 0.1, head.item_log)))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.r, self.c1, self.c2, self.b

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @staticmethod
    def unpack(flat: np.ndarray, items: int) -> LogBilinear:
        shapes = [(items + 1, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (items,)]
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
        return LogBilinear(*[part.reshape(x) for part, x in zip(parts, shapes)])

    def train(self, rows: np.ndarray, noise: np.ndarray, draw: np.random.Generator, squares: list[np.ndarray], epochs: int) -> None:
        """Noise-contrastive estimation over rows of ids (the item before the last, the last, the item), in minibatches of matrix products. A minibatch takes its rows from all over."""
        sums, log_noise = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)
        rows = np.ascontiguousarray(rows.T)  # a row's ids side by side
        small = np.int16 if len(self.r) < 1 << 15 else np.int64
        steps = max(1, len(rows) // min(BATCH, max(256, len(rows) // 64)))
        most = -(-len(rows) // steps)
        c, c_squares = np.concatenate([self.c1, self.c2]), np.concatenate(squares[1:3])  # the contexts' two items side by side
        # memory of a step, taken once: new pages at each would cost as much as the sums
        index = np.empty(3 * most + NOISE, np.intp)
        met, change, sorted_change, summed, square = (np.empty((len(index), WIDTH), np.float32) for _ in range(5))
        both = np.empty((3, most, WIDTH), np.float32)
        errors = np.empty((most, NOISE), np.float32)
        for step in np.concatenate([draw.permutation(steps) for _ in range(epochs)]).tolist():
            part = rows[step::steps]
            n = len(part)
            at = index[: 3 * n + NOISE]
            at[: 2 * n : 2], at[1 : 2 * n : 2], at[2 * n : 3 * n] = part[:, 1], part[:, 0], part[:, 2]
            at[3 * n :] = np.minimum(np.searchsorted(sums, draw.random(NOISE) * sums[-1]), len(noise) - 1)
            w, false = at[2 * n : 3 * n], at[3 * n :]
            r = np.take(self.r, at, 0, met[: len(at)], "clip")
            rxy, rw, rf = r[: 2 * n].reshape(n, 2 * WIDTH), r[2 * n : 3 * n], r[3 * n :]
            q, dq, other = both[:, :n]
            np.matmul(rxy, c, out=q)
            own = self.b - log_noise
            true_error = np.einsum("ij,ij->i", q, rw) + own[w]
            false_error = np.matmul(q, rf.T, out=errors[:n])
            false_error += own[false]
            for s in (true_error, false_error):  # to the probability of being no noise
                np.clip(s, -30, 30, out=s)
                np.negative(s, out=s)
                np.exp(s, out=s)
                s += 1
                np.reciprocal(s, out=s)
            true_error -= 1
            share = np.float32(1 / n)
            true_error *= share
            false_error *= share
            np.matmul(false_error, rf, out=dq)
            dq += np.multiply(true_error[:, None], rw, out=other)
            db = np.bincount(w, true_error, len(self.b)) + np.bincount(false, false_error.sum(0), len(self.b))
            np.matmul(dq, c.T, out=change[: 2 * n].reshape(n, 2 * WIDTH))
            np.multiply(true_error[:, None], q, out=change[2 * n : 3 * n])
            np.matmul(false_error.T, q, out=change[3 * n : len(at)])
            order = np.argsort(at.astype(small), kind="stable")
            held = at[order]
            first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            by_item = np.take(change, order, 0, sorted_change[: len(at)], "clip")
            # two columns at a time, as the parts of complex numbers
            np.add.reduceat(by_item.view(np.complex64), first, out=summed[: len(first)].view(np.complex64))
            self._step_at(self.r, squares[0], summed[: len(first)], held[first], square[: len(first)], sorted_change[: len(first)])
            self._step(c, c_squares, rxy.T @ dq)
            self._step(self.b, squares[3], db.astype(np.float32))
        self.c1, self.c2 = np.split(c, 2)
        squares[1], squares[2] = np.split(c_squares, 2)

    @staticmethod
    def _step(value: np.ndarray, squares: np.ndarray, change: np.ndarray) -> None:
        squares += change * change
        value -= RATE * change / np.sqrt(squares)

    @staticmethod
    def _step_at(value: np.ndarray, squares: np.ndarray, change: np.ndarray, at: np.ndarray, square: np.ndarray, other: np.ndarray) -> None:
        """_step() of the rows at, in the memory of square and other."""
        np.take(squares, at, 0, square, "clip")
        square += np.multiply(change, change, out=other)
        squares[at] = square
        change *= np.float32(RATE)
        change /= np.sqrt(square, out=square)
        np.subtract(np.take(value, at, 0, other, "clip"), change, out=other)
        value[at] = other

    def squares(self) -> list[np.ndarray]:
        return [np.full_like(x, 1e-6) for x in self.arrays()]

    def log_sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log of the sums of exponentials over all items for contexts (x before, y before that), by batched products."""
        out = np.empty(len(x), np.float32)
        own, weight = np.ascontiguousarray(self.r[:-1].T), np.exp(self.b)
        for i in range(0, len(x), 512):
            s = (self.r[x[i : i + 512]] @ self.c1 + self.r[y[i : i + 512]] @ self.c2) @ own
            top = s.max(1)
            top[np.abs(top) <= 60] = 0
            if top.any():
                s -= top[:, None]
            np.exp(s, out=s)
            out[i : i + 512] = np.log(s @ weight) + top
        return out

    def table(self, items: np.ndarray) -> np.ndarray:
        """log_sums() of all pairs of some items: [i, j] has items[j] before and items[i] before that.

        An item's exponential is the product of one that x gives and one that y gives, so the sums of all pairs are one
        matrix product, and exponentials are taken once for each x and y. Sums too small for the numbers' range are taken singly.
        """
        out = np.empty((len(items), len(items)), np.float32)
        own = np.ascontiguousarray(self.r[:-1].T)

        def parts(c: np.ndarray, at: np.ndarray, bias: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
            s = (self.r[at] @ c) @ own
            s += bias
            top = s.max(1)
            s -= top[:, None]
            return np.exp(s, out=s), top

        for i in range(0, len(items), 2048):
            y, top_y = parts(self.c2, items[i : i + 2048], self.b)
            for j in range(0, len(items), 256):
                x, top_x = parts(self.c1, items[j : j + 256], 0.0)
                s = y @ x.T
                low = np.argwhere(~(s > 1e-20))
                s[tuple(low.T)] = 1
                out[i : i + 2048, j : j + 256] = np.log(s, out=s) + (top_y[:, None] + top_x)
                if len(low):
                    low += (i, j)
                    out[tuple(low.T)] = self.log_sums(items[low[:, 1]], items[low[:, 0]])
        return out


def contexts(w: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The items before the last and the last before each token of some texts, one after the other, which have so many tokens each."""
    starts = np.cumsum(sizes) - sizes
    x, y = np.concatenate([[begin], w[:-1]]), np.concatenate([[begin, begin], w[:-2]])[: len(w)]
    x[starts] = y[starts] = begin
    y[starts[sizes > 1] + 1] = begin
    return y, x


def learn(model: LogBilinear, ids: list[np.ndarray], noise: np.ndarray, seed: int) -> None:
    """Trains on the items of some texts."""
    w = np.concatenate(ids)
    rows = np.stack([*contexts(w, np.array([len(x) for x in ids]), len(model.b)), w]).astype(np.int32)
    model.train(rows, noise, np.random.default_rng(seed), model.squares(), min(EPOCHS, max(1, LEAST_TOKENS // rows.shape[1])))


_ENCODED = "uid bigint, doc_id bigint, held boolean, h bigint, n_tokens bigint, n_known bigint, base double, inside double, items binary, rare array<binary>"


def encode(docs: DataFrame, head: Head, held: Column | None = None) -> DataFrame:
    """Texts (doc_id, text) as items, settled, with what counts of the head tell of them: n_tokens, n_known, base score and log10 of the words' parts of their groups without the words in rare. held marks texts that training leaves out."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        unit = float(np.log10(head.tokens + head.distinct + 1))
        log_count = np.append(head.log_count, 0.0)  # of no place: a word that the head lacks
        known = pa.array(list(head.place), pa.binary())
        end = head.place.get(END, -1)
        for part in slices(batches, "text", SLICE_BYTES):
            sizes, words = words_of(part.column("text"))
            found = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            rare = words.filter(pa.array(found < 0))
            met = pc.dictionary_encode(rare)
            groups = np.array([head.group(word) for word in met.dictionary.to_pylist()], np.int64)[met.indices.to_numpy()]
            ends = np.cumsum(sizes + 1) - 1
            word = np.ones(len(words) + len(sizes), bool)
            word[ends] = False
            places, ids = np.empty((2, len(word)), np.int64)
            places[word], places[ends] = found, end
            ids[word], ids[ends] = head.ids(found, groups), head.item[end] if end >= 0 else head.own
            starts = ends - sizes
            logs = log_count[places]
            grouped = ids >= head.own
            inside = np.where(grouped, logs, 0.0)
            inside[grouped] -= head.group_log[ids[grouped] - head.own]
            edges = pa.py_buffer(np.append(starts, len(ids)).astype(np.int32) * np.int32(4))
            items = pa.Array.from_buffers(pa.binary(), len(sizes), [None, edges, pa.py_buffer(ids.astype(np.int32))])
            lists = np.concatenate([[0], np.cumsum(found < 0)])[np.concatenate([[0], np.cumsum(sizes)])]
            base, n_known, inside = (np.add.reduceat(v, starts) for v in (logs, (places >= 0).astype(np.int64), inside))
            columns = [part.column(c) for c in ("uid", "doc_id", "held", "h")]
            columns += [pa.array(sizes + 1, pa.int64()), pa.array(n_known), pa.array(base - unit * (sizes + 1)), pa.array(inside), items, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ENCODED.split(", ")])

    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held is None else held).alias("held"), F.xxhash64("doc_id", "text").alias("h"), text_bytes().alias("text"))
    return settle(own.mapInArrow(run, _ENCODED))


def fit(docs: DataFrame, head: Head, seed: int = 5) -> LogBilinear:
    """fit_encoded() on every given text (doc_id, text)."""
    return fit_encoded(encode(docs, head), head, seed)


def fit_encoded(encoded: DataFrame, head: Head, seed: int = 5) -> LogBilinear:
    """Trains on every encoded text that is not held out, in ROUNDS rounds.

    Texts as items are dealt into parts of about PART_TOKENS tokens by a hash of id and text, so the parts, and up to
    rounding the model, do not depend on how the input is partitioned. In a round every part starts from the common
    parameters and passes over its tokens once, small parts several times; the average, weighted by tokens, is the next round's start.
    Averages are summed in tasks and in a shuffle; the driver gets as many numbers as the model has parameters.
    """
    model = LogBilinear.begin(head)
    if not head.tokens:
        return model
    context = encoded.sparkSession.sparkContext
    noise = np.exp(head.item_log * 0.75)
    parts = max(1, -(-head.tokens // PART_TOKENS))
    encoded = settle(encoded.filter("not held").select("h", F.col("items").alias("ids")).repartition(parts, "h").sortWithinPartitions("h", "ids").select(F.spark_partition_id().alias("part"), "ids"))
    for turn in range(ROUNDS):
        start = context.broadcast((noise, model.pack()))
        model = _average(encoded, head.items, start, seed + turn)
        start.unpersist()
    return model


def _average(encoded: DataFrame, items: int, start, seed: int) -> LogBilinear:
    def begin() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        noise, flat = start.value

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            total, n = np.zeros(len(flat)), 0
            for part, texts in groupby(rows, key=lambda row: row[0]):
                held, size = [], 0
                own = LogBilinear.unpack(flat.copy(), items)
                for _, ids in texts:
                    held.append(np.frombuffer(ids, np.int32).astype(np.int64))
                    size += len(held[-1])
                    if size >= 2 * PART_TOKENS:  # of a part that very long texts have made larger
                        learn(own, held, noise, seed + part)
                        total, n = total + own.pack().astype(np.float64) * size, n + size
                        held, size, own = [], 0, LogBilinear.unpack(flat.copy(), items)
                if held:
                    learn(own, held, noise, seed + part)
                    total, n = total + own.pack().astype(np.float64) * size, n + size
            if n:
                for i in range(0, len(total), 64):
                    yield (i, total[i : i + 64], n), 600

        return step

    schema = pa.schema([("at", pa.int64()), ("part", pa.list_(pa.float64())), ("n", pa.int64())])
    parts = row_map(encoded, "at bigint, part array<double>, n bigint", begin, schema)
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.get("part", F.lit(i))).alias(f"p{i}") for i in range(64)]).collect()
    flat = np.zeros(len(start.value[1]))
    for row in sums:
        values = [row[f"p{i}"] for i in range(64)]
        values = [v for v in values if v is not None]
        flat[row["at"] : row["at"] + len(values)] = np.array(values) / row["n"]
    return LogBilinear.unpack(flat, items)


def _kept_sums(model: LogBilinear, name: str, frequent: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log sums of contexts. Those of two frequent items are in a table that the worker keeps from task to task; each other one is taken once for all the given contexts."""
    n = len(model.b) + 1
    table = kept(name, lambda: model.table(frequent))
    place = np.full(n, -1)
    place[frequent] = np.arange(len(frequent))
    at_y, at_x = place[y], place[x]
    out = table[at_y, at_x]
    rest = np.flatnonzero((at_y < 0) | (at_x < 0))
    if len(rest):
        met, back = np.unique(y[rest] * n + x[rest], return_inverse=True)
        out[rest] = model.log_sums(met % n, met // n)[back]
    return out


def score(docs: DataFrame, counts: DataFrame, head: Head, model: LogBilinear) -> DataFrame:
    """score_encoded() of every given text (doc_id, text)."""
    return score_encoded(encode(docs, head), counts, head, model)


def score_encoded(encoded: DataFrame, counts: DataFrame, head: Head, model: LogBilinear) -> DataFrame:
    """Scores of every whole text.

    Of docs (doc_id, text) other columns are ignored. Returns a row for each row: doc_id, held, n_tokens, n_known,
    base_score (add-one unigram), score (log10 probability by the model). A null or empty text is its end
    alone. Repeated rows are scored each; very long texts whole. An empty table gives none. Words of the head are
    looked up; all others meet their counts in a join by word, none of them frequent enough to fill a task.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    frequent = np.concatenate([[head.items], np.argsort(-head.item_log, kind="stable")])[: math.isqrt(TABLE)]  # the beginning first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        before1, before2 = model.r @ model.c1, model.r @ model.c2
        left, right, of_y = np.empty((3, 4096, WIDTH), np.float32)
        for part in slices(batches, "items", 4 * CHUNK):
            edges = _edges(part.column("items")) // 4
            w = np.frombuffer(part.column("items").buffers()[2], np.int32)[edges[0] : edges[-1]].astype(np.int64)
            y, x = contexts(w, np.diff(edges), len(model.b))
            logs = np.empty(len(w), np.float64)
            for i in range(0, len(w), len(left)):
                s = slice(i, i + len(left))
                n = len(w[s])
                np.take(before1, x[s], 0, left[:n], "clip")
                left[:n] += np.take(before2, y[s], 0, of_y[:n], "clip")
                logs[s] = np.einsum("ij,ij->i", left[:n], np.take(model.r, w[s], 0, right[:n], "clip"))
            logs += model.b[w] - _kept_sums(model, name, frequent, y, x)
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(np.add.reduceat(logs, edges[:-1] - edges[0]) / np.log(10))], ["uid", "model"])

    logs = encoded.select("uid", "items").mapInArrow(run, "uid bigint, model double")
    own = F.concat(F.unhex(F.lit("FF")), F.col("uid").cast("string").cast("binary"))  # no word: so rows of texts spread too
    of_text = ["doc_id", "held", "n_tokens", "n_known", "base", "inside"]
    rows = encoded.select("uid", *of_text, F.posexplode(F.concat(F.array(own), "rare")).alias("at", "word"))
    rows = rows.select("uid", "word", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in of_text])
    rare = _tail(counts, head.least).select("word", F.log10(F.col("n") + 1).alias("part"))
    rows = rows.join(rare, "word", "left").drop("word").unionByName(logs, allowMissingColumns=True)
    totals = rows.groupBy("uid").agg(*[F.max(c).alias(c) for c in (*of_text, "model")], F.count("part").alias("met"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("parts"))
    return totals.select("doc_id", "held", "n_tokens", (F.col("n_known") + F.col("met")).alias("n_known"), (F.col("base") + F.col("parts")).alias("base_score"), (F.col("model") + F.col("inside") + F.col("parts")).alias("score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 7, 2)
    training = docs.filter(~out)
    counts = settle(count_words(training))
    head = head_of(counts)
    encoded = encode(docs, head, out)
    scored = score_encoded(encoded, counts, head, fit_encoded(encoded, head))
    return scored.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(head.tokens).cast("long").alias("train_tokens"), "base_score", "score")
