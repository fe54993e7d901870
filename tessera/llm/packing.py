"""Best-fit packing of documents into sequences, with partitions certified by lower bounds and repacked together where a gap is left.

Documents become pieces of at most one sequence. Pieces are dealt into partitions of bounded size, and a partition is
known by its count of each length, so best-fit decreasing runs over counts: all pieces of one length and all bins with
one free space are moved at once. Dual-feasible functions bound the bins that a partition needs; one that has a gap to
its bound gives its documents to a group of eight such partitions, which is packed anew, and so on until no gap is left,
the bound of all is met, or one group is left. Then each piece looks up its place by its length and its number among
the pieces of that length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import kept, row_map, settle, table

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 2048, 0
#: Pieces of a partition at most and at least, partitions from which they grow, and partitions that are packed together in the next level.
MOST, LEAST, SPREAD, JOINED = 131072, 2048, 64, 8
#: Repackings tried by a group that has no other to exchange with.
TRIES = 24
#: Strings each worker keeps the ids of; longer ones than KEPT_CHARS are not kept, and longer ones than PARTED_CHARS not parted.
KEPT, KEPT_CHARS, PARTED_CHARS = 1_200_000, 40, 160
#: A blank that begins a word.
BLANK = re.compile(r"(?<=\S) ")
#: Marks but the apostrophe, which the byte-level pattern treats apart: it matches others in runs. Characters after which a run of marks is a match of its own, and those between which a line end is one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BEFORE_MARKS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c not in "ªµº" or c in "0123456789")
VISIBLE = BEFORE_MARKS | frozenset(MARKS + "'")
#: One match: letters of the Latin blocks, digits, marks, or a line end.
MATCH = re.compile(rf"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[{re.escape(MARKS)}]+|\n")
#: How byte-level tokenizers write bytes: those that Latin-1 prints as they are, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class Encoder(dict):
    """Ids of texts as little-endian 32-bit numbers, by one tokenizer whose words begin at a blank.

    The byte-level pattern always ends a match before a blank that follows something else than white space, so the strings
    between such blanks are encoded by themselves, and those met before are looked up. A new one is parted at
    marks and line ends, where matches end in any case, the parts are looked up too, and one of a single match goes to the merges at once.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.inner: dict[str, bytes] = {}  # parts that no blank begins
        state = json.loads(self.tokenizer.to_str())
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_match = state["normalizer"] is None and bytewise.items() <= (state["pre_tokenizer"] or {}).items()

    def match(self, text: str) -> bytes:
        """Ids of a match of the pattern."""
        found = self.merges.tokenize(text.encode().decode("latin-1").translate(WRITTEN))
        return struct.pack(f"<{len(found)}I", *[token.id for token in found])

    def after(self, text: str) -> bytes:
        """Ids of a part that no blank begins."""
        found = self.inner.get(text)
        if found is None:
            found, parted = self.parts(text, self.after, "")
            if len(text) <= KEPT_CHARS and len(self) + len(self.inner) < (KEPT // 2 if parted else KEPT):
                self.inner[text] = found
        return found

    def parts(self, text: str, get: Callable[[str], bytes], blank: str) -> tuple[bytes, bool]:
        """Ids of a string, which get() gives for what it begins with, and whether it was parted."""
        if self.by_match and len(text) <= PARTED_CHARS:
            stem = text.rstrip(MARKS)
            if len(stem) < len(text) and stem[-1:] in BEFORE_MARKS:
                return get(stem) + self.after(text[len(stem) :]), True
            first, line, last = text.rpartition("\n")
            if line and first[-1:] in VISIBLE and last[:1] in VISIBLE:
                return get(first) + self.after(line) + self.after(last), True
            if MATCH.fullmatch(text) and (text != "\n" or not blank):
                return self.match(blank + text), False
        return self.ids(blank + text), False

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found, parted = self.parts(word, self.__getitem__, " ")
        # what can be put together from parts takes half of the room at most
        if len(word) <= KEPT_CHARS and len(self) + len(self.inner) < (KEPT // 2 if parted else KEPT):
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not first or "" in words or any(map(str.isspace, {w[-1] for w in words} | {first[-1]})):  # white space before a blank
            first, *words = BLANK.split(text)
        return self.ids(first) + b"".join(map(self.__getitem__, words))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as token ids, cut into pieces of at most capacity.

    docs: doc_id, text; other columns are ignored. A document is its ids and END; one that is longer than capacity is cut into
    pieces of capacity, and its first piece has what is left over. Returns per piece doc_id, piece (from 0), start, length,
    ids_crc32 (of the ids as little-endian 32-bit numbers) and, with_ids, ids. A null or empty text is one piece of END alone;
    repeated rows and null ids are documents like all others; an empty table gives no rows.
    """

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        encoder = kept(f"packing {path}", lambda: Encoder(path))
        end = np.array([END], "<u4").tobytes()

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = ids[4 * a : 4 * b]
                    yield (doc_id, i, a, b - a, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None), 48 + len(own) * with_ids

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
    doc_id = F.col("doc_id") if kind == "bigint" else F.col("doc_id").cast("string")
    out = row_map(docs.select(doc_id.alias("doc_id"), "text"), f"doc_id {'bigint' if kind == 'bigint' else 'string'}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>", start, arrow)
    return out if with_ids else out.drop("ids")


def bound(counts: np.ndarray) -> int:
    """Tokens that bins must offer at least for so many pieces of each length (counts[l]; the capacity is its last index).

    The largest of the sums of three families of dual-feasible functions: the length itself; thresholds, by which a length
    over capacity - e counts as a whole bin and one under e as nothing; and rounded multiples, by which x counts as floor((k + 1) x) / k.
    """
    c = len(counts) - 1
    x = np.arange(c + 1, dtype=np.int64)
    many, sizes = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(1, c // 2 + 1)
    found = [int(sizes[-1]), int(((many[-1] - many[c - e + 1]) * c + sizes[c - e + 1] - sizes[e]).max(initial=0))]
    for k in range(1, min(c, 100)):
        y = (k + 1) * x
        found.append(-(-int((counts * np.where(y % c == 0, k * x, y // c * c)).sum()) // k))
    return max(found)


class Bins:
    """Bins by content, in groups of equal ones: (pieces as ((length, how many), ...), free space, bins)."""

    def __init__(self, counts: np.ndarray):
        """Best-fit decreasing. A piece goes to the bin with the least free space that holds it, and so does the next of its length, as the space has become less."""
        c = len(counts) - 1
        free: list[list[tuple[tuple, int]]] = [[] for _ in range(c + 1)]
        some = np.zeros(c + 1, bool)

        def put(content: tuple, space: int, n: int) -> None:
            if n:
                free[space].append((content, n))
                some[space] = True

        for length in np.flatnonzero(counts)[::-1].tolist():
            left = int(counts[length])
            while left:
                space = length + int(some[length:].argmax())
                if some[space]:
                    content, n = free[space].pop()
                    some[space] = bool(free[space])
                else:
                    content, space, n = (), c, -(-left // (c // length))
                k = space // length
                full = min(n, left // k)
                rest = min(left - full * k, k - 1) if full < n else 0
                put((*content, (length, k)), space - k * length, full)
                if rest:
                    put((*content, (length, rest)), space - rest * length, 1)
                put(content, space, n - full - (rest > 0))
                left -= full * k + rest
        self.groups = [(content, space, n) for space, held in enumerate(free) for content, n in held]

    @property
    def number(self) -> int:
        return sum(n for _, _, n in self.groups)

    def counts(self, groups: list[tuple], c: int) -> np.ndarray:
        out = np.zeros(c + 1, np.int64)
        for content, _, n in groups:
            for length, k in content:
                out[length] += k * n
        return out

    def improve(self, c: int, goal: int) -> None:
        """Empties the bins with free space and a share of the others, packs their pieces anew, and keeps what needs fewer bins."""
        draw = np.random.default_rng(7)
        for _ in range(TRIES):
            if self.number <= goal:
                return
            stay, go = [], []
            for group in self.groups:
                (go if group[1] or draw.random() < 0.5 else stay).append(group)
            again = Bins(self.counts(go, c))
            if again.number <= sum(n for _, _, n in go):
                self.groups = stay + again.groups

    def runs(self) -> list[tuple[int, int, int, int, int, int]]:
        """Where the pieces of each length go: (length, first, last + 1, bin, pieces a bin, offset in it), the pieces of a length being numbered from 0."""
        taken: dict[int, int] = {}
        out, at = [], 0
        for content, _, n in self.groups:
            offset = 0
            for length, k in content:
                first = taken.get(length, 0)
                out.append((length, first, first + k * n, at, k, offset))
                taken[length] = first + k * n
                offset += length * k
            at += n
        return out


RUNS = "g bigint, length bigint, first bigint, last bigint, bin bigint, each bigint, offset bigint, bins bigint, gap bigint"


def _packed(counts: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Runs of each group g of counts (g, length, n), with the number of bins and the gap to the bound in tokens."""
    names = [part.split()[0] for part in RUNS.split(", ")]

    def pack(rows: pa.Table) -> pa.Table:
        held = np.zeros(capacity + 1, np.int64)
        np.add.at(held, rows["length"].to_numpy(), rows["n"].to_numpy())
        bins, least = Bins(held), bound(held)
        if last:
            bins.improve(capacity, -(-least // capacity))
        runs = np.array(bins.runs(), np.int64).reshape(-1, 6)
        n = len(runs)
        columns = [np.full(n, rows["g"][0].as_py()), *runs.T, np.full(n, bins.number), np.full(n, bins.number * capacity - least)]
        return pa.table(dict(zip(names, columns)))

    return counts.groupBy("g").applyInArrow(pack, RUNS)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (length, from 1 to capacity, and any other columns) with sequence_id and offset: sequences of at most capacity, gapless from 0, as few as the method finds.

    Pieces of the whole capacity are sequences of their own. Which of several pieces of one length goes where is arbitrary; equal
    rows are pieces each; an empty table gives none.
    """
    names = rows.columns
    held = settle(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("length").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("uid")))
    whole, part = held.filter(F.col("length") >= capacity), held.filter(F.col("length") < capacity)
    n = part.count()
    parts = max(1, -(-n // min(MOST, max(LEAST, n // SPREAD))))
    part = part.withColumn("p", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    counts = settle(part.groupBy("p", "length").agg(F.count("*").alias("n")))
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        total[r.length] = r.n
    goal = -(-bound(total) // capacity)

    left, closed, done, level = counts, None, 0, 0
    while True:
        width = JOINED**level
        last = width >= parts
        own = left.withColumn("g", F.floor(F.col("p") / width) * width)
        runs = settle(_packed(own.groupBy("g", "length").agg(F.sum("n").alias("n")), capacity, last))
        groups = runs.groupBy("g").agg(F.first("bins").alias("bins"), F.first("gap").alias("gap"))
        seen = groups.agg(F.sum("bins").alias("bins"), F.sum(F.when(F.col("gap") == 0, F.col("bins")).otherwise(0)).alias("full")).first()
        last = last or done + (seen.bins or 0) <= goal or seen.full == seen.bins
        done += seen.full or 0
        over = runs if last else runs.filter("gap = 0")
        open_groups = groups.filter("gap > 0").select("g")
        here = own if last else own.join(open_groups, "g", "left_anti")
        # the pieces of a group are numbered by partition
        before = Window.partitionBy("g", "length").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        places = here.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        met = places.join(over.select("g", "length", "first", "last", "bin", "each", "offset"), ["g", "length"]).filter((F.col("first") < F.col("base") + F.col("n")) & (F.col("last") > F.col("base")))
        met = met.select("p", "g", "length", (F.col("first") - F.col("base")).alias("first"), (F.col("last") - F.col("base")).alias("last"), "bin", "each", "offset")
        closed = met if closed is None else closed.union(met)
        if last:
            break
        left = settle(own.join(open_groups, "g").select("p", "length", "n"))
        level += 1
    placed = _placed(part, closed)
    alone = whole.select("row", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.union(alone).select(*[F.col("row")[c].alias(c) for c in names], "sequence_id", "offset")


def _placed(part: DataFrame, runs: DataFrame) -> DataFrame:
    """row, sequence_id and offset: a piece's number among those of its length in its partition leads to its run, and that to its bin."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        length, uid = left["length"].to_numpy(), left["uid"].to_numpy()
        sequence, offset = np.empty(len(uid), np.int64), np.empty(len(uid), np.int64)
        if len(uid):
            order = np.lexsort((uid, length))
            sizes = length[order]
            number = np.arange(len(order)) - np.searchsorted(sizes, sizes)
            right = right.sort_by([("length", "ascending"), ("first", "ascending")])
            r = {name: right[name].to_numpy() for name in ("g", "length", "first", "bin", "each", "offset")}
            scale = len(order) + 1
            run = np.searchsorted(r["length"] * scale + np.maximum(r["first"], 0), sizes * scale + number, side="right") - 1
            along = number - r["first"][run]
            sequence[order] = ((r["g"][run] << 36) + r["bin"][run] + along // r["each"][run]) << 1
            offset[order] = r["offset"][run] + along % r["each"][run] * sizes
        return pa.table({"row": left["row"], "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return part.select("p", "length", "uid", "row").groupBy("p").cogroup(runs.groupBy("p")).applyInArrow(place, T.StructType([part.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id and ids, from rows of pack() that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
