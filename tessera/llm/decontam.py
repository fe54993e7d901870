"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity.

Every window of every text is fingerprinted, for each class of item sizes; candidates are the windows that the
block tables name and that are within RADIUS bits of an item. Only these are verified.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kept, row_map, scratch, settle, table, text_bytes
from tessera.llm.shingles import NEAR, SHINGLE_WORDS, shingled, word_hashes

#: Fingerprints of 64 bits are cut into so many blocks; those within NEAR_BITS of one block are looked up. All pairs within RADIUS bits are found.
BLOCKS, NEAR_BITS = 4, 4
RADIUS = BLOCKS * (NEAR_BITS + 1) - 1
#: Items of a class differ by less than one shingle in so many; they share windows of a size in the middle.
CLASS_SHARE = 6
#: Bytes of benchmark text, and items, that go to the workers at once; a larger benchmark is worked off in parts by item, one after the other.
PART_BYTES, PART_ITEMS = 16 << 20, 4096
#: Windows that are fingerprinted at once, and shingles that a worker holds before it does, about.
SLICE, HELD = 16384, 65536
#: Bits by which shingles are looked up before they are searched for.
KNOWN_BITS = 20
_LAST = np.uint64((1 << KNOWN_BITS) - 1)
_FLIPS = np.array([sum(1 << b for b in bits) for n in range(NEAR_BITS + 1) for bits in combinations(range(64 // BLOCKS), n)], np.uint16)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each hash."""
    return np.unpackbits(hashes.view(np.uint8)).view(np.int8).reshape(-1, 64) * np.int8(2) - np.int8(1)


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of sums of signs; a sum of zero is a zero bit."""
    return np.packbits(sums > 0).view(np.uint64)


class Class:
    """Items of about one size: their fingerprints, and for each block a table of the values that are near one of them."""

    def __init__(self, window: int, items: list[int], prints: np.ndarray, parts: np.ndarray):
        self.window, self.items, self.prints, self.parts = window, np.array(items), prints, parts
        self.tables = np.zeros((BLOCKS, 1 << 64 // BLOCKS), bool)
        for blocks in prints.view(np.uint16).reshape(-1, BLOCKS):
            for table, block in zip(self.tables, blocks):
                table[block ^ _FLIPS] = True

    def near(self, prints: np.ndarray, can: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, place in the class) within RADIUS bits: all of them, as one block at least is then within NEAR_BITS.

        Of the places that the tables name, can() tells those that verification can accept; the others need no distance.
        """
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.intp)
        named = self.tables[0].take(blocks[:, 0])
        for k in range(1, BLOCKS):
            named |= self.tables[k].take(blocks[:, k])
        at = np.flatnonzero(named)
        at = at[can(at)]
        row, item = np.nonzero(np.bitwise_count(prints[at][:, None] ^ self.prints) <= RADIUS)
        return at[row], item


class Index:
    """Items of a benchmark: their shingles with weights (counts), and classes of their fingerprints by width of shingles and size."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items: list[tuple[int, int, int, dict[int, int]]] = []  # id, words, shingles, their counts
        prints, runs = [], defaultdict(list)
        by_size: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = word_hashes(text)[0]
            if not len(words):
                continue
            hashes = shingled(words)
            width = min(SHINGLE_WORDS, len(words))
            by_size[width][len(hashes)].append(len(self.items))
            runs[width].append(hashes)
            distinct, counts = np.unique(hashes, return_counts=True)
            self.items.append((item_id, len(words), len(hashes), dict(zip(distinct.tolist(), counts.tolist()))))
            prints.append(_packed(_signs(hashes).sum(0, dtype=np.int32))[0])
        prints, parts = np.array(prints, np.uint64), np.array([x[2] for x in self.items])
        self.known = {width: np.unique(np.concatenate(found)) for width, found in runs.items()}
        #: Whether some known shingle ends in these KNOWN_BITS bits.
        self.may = {width: np.zeros(1 << KNOWN_BITS, bool) for width in runs}
        for width, known in self.known.items():
            self.may[width][(known & _LAST).astype(np.intp)] = True
        self.classes: dict[int, list[Class]] = {}
        for width, sizes in by_size.items():
            self.classes[width], left = [], sorted(sizes)
            while left:
                own = [n for n in left if n < left[0] + max(1, left[0] // CLASS_SHARE)]
                left = left[len(own) :]
                members = [i for n in own for i in sizes[n]]
                self.classes[width].append(Class((own[0] + own[-1] + 1) // 2, members, prints[members], parts[members]))

    def matches(self, texts: Iterable[bytes | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text (item id, first word, end word, similarity) of the best window for each item that it holds, by item.

        Windows are as long as the item; a shorter text is the one window.
        """
        texts = [text or b"" for text in texts]
        words, starts = word_hashes(b" ".join(texts))
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(text) + 1 for text in texts]))
        runs = [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        best: list[dict[int, tuple[float, int]]] = [{} for _ in runs]
        for width, classes in self.classes.items():
            at = [i for i, w in enumerate(runs) if len(w) >= width]
            if at:
                self._search(width, classes, at, [shingled(runs[i], width) for i in at], best)
        items = self.items
        return [[(items[j][0], start, min(start + items[j][1], len(w)), similarity) for j, (similarity, start) in sorted(found.items())] for found, w in zip(best, runs)]

    def _search(self, width: int, classes: list[Class], at: list[int], runs: list[np.ndarray], best: list[dict]) -> None:
        sizes = np.array([len(h) for h in runs])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hashes = np.concatenate(runs)
        known = self.known[width]
        hit = np.zeros(len(hashes), bool)
        at_all = np.flatnonzero(self.may[width].take((hashes & _LAST).astype(np.intp)))
        hit[at_all] = known[np.minimum(np.searchsorted(known, hashes[at_all]), len(known) - 1)] == hashes[at_all]
        hits = np.concatenate([[0], np.cumsum(hit)])
        pairs: set[tuple[int, int]] = set()

        def enough(low: np.ndarray, high: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
            """A window between low and high can only be similar with so many of the benchmark's shingles."""
            return 100 * (hits[high] - hits[low]) >= NEAR * parts

        longest = max(c.window for c in classes)
        kind = np.int8 if longest < 128 else np.int32
        for a in range(0, len(hashes), SLICE):
            piece = hashes[a : a + SLICE + longest]
            sums = np.zeros((len(piece) + 1, 64), kind)
            np.cumsum(_signs(piece), axis=0, dtype=kind, out=sums[1:])
            for c in classes:
                n = min(SLICE, len(piece) - c.window + 1)
                if n < 1:
                    continue
                off, least = int(np.abs(c.parts - c.window).max()), int(c.parts.min())
                row, item = c.near(_packed(sums[c.window : c.window + n] - sums[:n]), lambda at: enough(np.maximum(at + a - off, 0), np.minimum(at + a + c.window + off, len(hashes)), least))
                text = np.searchsorted(ends, row + a, side="right")
                off = np.abs(c.parts[item] - c.window)
                keep = enough(np.maximum(row + a - off, begins[text]), np.minimum(row + a + c.window + off, ends[text]), c.parts[item])
                pairs.update(zip(text[keep].tolist(), c.items[item[keep]].tolist()))
        short = np.flatnonzero(sizes < max(int(c.parts.max()) for c in classes))
        if len(short):  # shorter than some item: the text itself is a window
            own = np.add.reduceat(_signs(np.concatenate([runs[i] for i in short])), np.cumsum(sizes[short]) - sizes[short], axis=0, dtype=np.int32)
            prints = _packed(own)
            for c in classes:
                row, item = c.near(prints, lambda at: enough(begins[short[at]], ends[short[at]], int(c.parts.min())))
                keep = enough(begins[short[row]], ends[short[row]], c.parts[item])
                pairs.update(zip(short[row[keep]].tolist(), c.items[item[keep]].tolist()))
        for text, j in pairs:
            a, b = begins[text], ends[text]
            if (found := self._best(runs[text], hits[a : b + 1] - hits[a], j)) is not None:
                best[at[text]][j] = found

    def _best(self, hashes: np.ndarray, hits: np.ndarray, item: int) -> tuple[float, int] | None:
        """Similarity and start of the item's best window, the first of equals, if it is near: weighted Jaccard, the sum of the lesser counts over that of the greater."""
        _, _, parts, own = self.items[item]
        size = min(parts, len(hashes))
        starts = np.flatnonzero(100 * (hits[size:] - hits[:-size]) >= NEAR * parts).tolist()
        best, seen, both, last = (0.0, 0), {}, 0, -2
        for start in starts:
            if start == last + 1:
                h = int(hashes[last])
                seen[h] -= 1
                both -= seen[h] < own.get(h, 0)
                new = hashes[start + size - 1 : start + size].tolist()
            else:
                seen, both = {}, 0
                new = hashes[start : start + size].tolist()
            for h in new:
                n = seen.get(h, 0)
                both += n < own.get(h, 0)
                seen[h] = n + 1
            last = start
            similarity = both / (size + parts - both)
            if similarity > best[0]:
                best = (similarity, start)
                if both == size == parts:
                    break
        return best if best[0] >= NEAR / 100 else None


def parts_of(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items (item_id, text as bytes) in parts of about PART_BYTES and PART_ITEMS, each fetched when it is asked for; null texts are left out."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    size, count = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(-(-(size or 0) // PART_BYTES), -(-count // PART_ITEMS))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield [(r.item_id, bytes(r.text)) for r in items.filter(own == i).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of documents that are near copies of benchmark items: doc_id, item_id, first_word, end_word, similarity.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A row for each document row and
    item with a window, as many words long as the item or the whole of a shorter text, whose five-word shingles
    have a weighted similarity of at least 0.75 with the item's; the best window, the first of equals. Items of fewer than
    five words are one shingle; texts and items without words, or null, match nothing; repeated items match each,
    repeated rows are searched each, very long texts whole; an empty table on either side gives none. Only the
    benchmark goes to all workers, in parts of a bounded size; with several parts the results of each are written before the next is fetched.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("similarity", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))

    def search(items: list[tuple[int, bytes]]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
            index = kept(name, lambda: Index(shared.value))

            def flush(held: list[tuple]) -> Iterator[tuple]:
                for (doc_id, _), found in zip(held, index.matches(text for _, text in held)):
                    for match in found:
                        yield (doc_id, *match), 40

            def step(rows: Iterator[tuple]) -> Iterator[tuple]:
                held, size = [], 0
                for row in rows:
                    held.append(row)
                    size += len(row[1])
                    if size >= 6 * HELD:
                        yield from flush(held)
                        held, size = [], 0
                if held:
                    yield from flush(held)

            return step

        return row_map(rows, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, similarity double", start, schema)

    parts = parts_of(benchmark)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return search(first)
    path = scratch(spark, "leaks")
    for items in (first, second):
        search(items).write.mode("append").parquet(path)
    for items in parts:
        search(items).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def leaks(spark: SparkSession, items: list[tuple[int, bytes]], text: Column) -> Column:
    """Whether a text holds a near copy of any of the given items, a part of a benchmark: a condition on rows, so a filter by it moves nothing."""
    return _holds(spark.sparkContext.broadcast(items), uuid.uuid4().hex)(F.coalesce(text.cast("binary"), F.lit(b"")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (text, any other columns) that hold no near copy of a benchmark item, as find_leaks() has it; a null text stays. Rows are written between the parts of a large benchmark."""
    parts = parts_of(benchmark)
    items = next(parts, None)
    while items is not None:
        docs = docs.filter(~leaks(docs.sparkSession, items, F.col("text")))
        items = next(parts, None)
        docs = docs if items is None else settle(docs)
    return docs


def _holds(shared, name: str) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        index, out, held, size = kept(name, lambda: Index(shared.value)), [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= 6 * HELD:
                out += map(bool, index.matches(held))
                held, size = [], 0
        return pd.Series(out + list(map(bool, index.matches(held))), dtype=bool)

    return holds


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
