"""Repeated substrings of exact length by merging the Burrows-Wheeler transforms of shards.

Repeats of LENGTH bytes are found in two steps. A window of LENGTH bytes is known by its minimizer, the
GRAM bytes in it of least hash, so equal windows meet under one key, and runs of windows with the same
minimizer make one string. Strings whose key is met once hold no repeat; where all strings of a key are
equal, all of them is repeated. For all other keys one of each of the different strings goes to tasks that build the
transform of each shard of them and merge these: the interleaving of all shards' suffixes by their first
k bytes is refined to k + 1 bytes by a stable pass over the transforms' characters, without a comparison of
suffixes. Blocks of suffixes that are equal so far are the intervals of common prefix k; those of one
suffix are settled and leave. What is left after LENGTH passes are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column_map, lookup, row_map, settle, table, text_bytes
from tessera.llm.shingles import mixed, powers

#: Bytes of a repeat, of a minimizer, and of the part of a text that is scanned at once.
LENGTH, GRAM, SCAN = 200, 64, 4 << 20
#: Bytes of strings that are merged at once, and of a shard.
MERGE_BYTES, SHARD_BYTES = 4 << 20, 1 << 18
#: Bytes of different strings of one key that go to a merge; the windows of keys with more are keys of their own.
KEY_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: first window, number of windows, hash of the minimizer."""
    n = len(data)
    windows = n - LENGTH + 1
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    full = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    keys = (full & ~_PLACE) | np.arange(len(full), dtype=np.uint64)  # ties to the leftmost
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    least = np.minimum(keys[:windows], keys[width - span : width - span + windows]) & _PLACE
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return first, np.diff(np.append(first, windows)), full[least[first].astype(np.int64)]


def scans(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that hold each window once."""
    for at in range(0, max(0, len(text) - LENGTH + 1), SCAN):
        yield at, np.frombuffer(text, np.uint8, min(SCAN + LENGTH - 1, len(text) - at), at)


_OCCURRENCE = "h bigint, s bigint, uid bigint, start bigint, size int"
_OCCURRENCE_ARROW = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("size", pa.int32())])


def occurrences(rows: DataFrame) -> DataFrame:
    """h, s, uid, start, size of each run's string in rows of (uid, text); h is of its minimizer, s a hash of all its bytes."""

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            digest = xxhash.xxh64_intdigest
            for uid, text in rows:
                for at, data in scans(text):
                    first, count, h = runs(data)
                    begin, size = first + at, count + LENGTH - 1
                    s = np.fromiter((digest(text[a : a + n]) for a, n in zip(begin.tolist(), size.tolist())), np.uint64, len(begin))
                    if len(begin):
                        yield h.view(np.int64), s.view(np.int64), np.full(len(begin), uid), begin.astype(np.int64), size.astype(np.int32)

        return step

    return column_map(rows, _OCCURRENCE, start, _OCCURRENCE_ARROW)


def windows_of(rows: DataFrame) -> DataFrame:
    """As occurrences, of each window of some strings, in rows of (uid, text, strings array<struct<start, size>>): h and s are two hashes of its bytes."""

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            digest, pair = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
            for uid, text, strings in rows:
                begin = np.concatenate([np.arange(x["start"], x["start"] + x["size"] - LENGTH + 1) for x in strings])
                h, s = (np.fromiter((f(text[a : a + LENGTH]) for a in begin.tolist()), np.uint64, len(begin)).view(np.int64) for f in (pair, digest))
                yield h, s, np.full(len(begin), uid), begin.astype(np.int64), np.full(len(begin), LENGTH, np.int32)

        return step

    return column_map(rows, _OCCURRENCE, start, _OCCURRENCE_ARROW)


# ---- shards and their merge


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; suffixes that are settled take no further part."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key * 258 + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # of the first suffix of its block, from 1; 0 is beyond the end
    edge = np.r_[True, key[order][1:] != key[order][:-1]]
    head = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    rank[order] = head + 1
    same = ~(edge & np.r_[edge[1:], True])
    places = np.flatnonzero(same)
    depth = 7
    while len(places):
        at = order[places]
        second = rank[np.minimum(at + depth, n)]
        sort = np.lexsort((second, rank[at]))
        at, first, second = at[sort], rank[at][sort], second[sort]
        order[places] = at
        edge = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        head = np.maximum.accumulate(np.where(edge, places, 0))
        rank[at] = head + 1
        places = places[~(edge & np.r_[edge[1:], True])]
        depth *= 2
    return order


class Shard:
    """Transform of some strings: for each suffix in order its position, the character before it, and the place of the suffix one longer.

    seeds: places of the suffixes that begin where a window of length bytes of their string ends.
    """

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) + 1 for s in strings])
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text = np.zeros(sizes.sum(), np.int16)  # 0 ends a string
        bytes_at = np.ones(len(text), bool)
        bytes_at[np.cumsum(sizes) - 1] = False
        text[bytes_at] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
        self.order = suffix_array(text)
        before = np.where(self.order > 0, self.order - 1, len(text) - 1)
        self.character = text[before]
        place = np.empty(len(text), np.int64)
        place[self.order] = np.arange(len(text))
        self.longer = place[before]
        windows = np.maximum(sizes - length, 0)
        first = np.repeat(self.begin + length - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
        self.seeds = np.sort(place[first + np.arange(len(first))])


def repeated(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each of some different strings the windows of length bytes that start anywhere else in them too."""
    shards, members, size = [], [[]], 0
    for i, s in enumerate(strings):
        if size + len(s) > shard_bytes and members[-1]:
            members.append([])
            size = 0
        members[-1].append(i)
        size += len(s)
    shards = [Shard([strings[i] for i in m], length) for m in members if m]
    if not shards:
        return []
    base = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])])
    character = np.concatenate([s.character for s in shards])
    character = (character - 1).astype(np.uint8)  # strings' ends lie before no part of a window
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base)]).astype(np.int32)
    # the interleaving: the suffixes of all shards that windows end at, equal so far in all of their no characters
    at = np.concatenate([s.seeds + b for s, b in zip(shards, base)]).astype(np.int32)
    block = np.zeros(len(at), np.int32)
    for _ in range(length):
        c = character[at]
        turn = np.argsort(c, kind="stable")
        c, block, at = c[turn], block[turn], longer[at[turn]]
        edge = np.empty(len(at) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(block[1:], block[:-1], out=edge[1:-1])
        edge[1:-1] |= c[1:] != c[:-1]
        more = ~(edge[:-1] & edge[1:])
        block = np.cumsum(edge[:-1], dtype=np.int32)[more]
        at = at[more]
        if not len(at):
            break
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    shard_of = np.searchsorted(base, at, side="right") - 1
    for k, (shard, m) in enumerate(zip(shards, [m for m in members if m])):
        position = np.sort(shard.order[at[shard_of == k] - base[k]])
        string = np.searchsorted(shard.begin, position, side="right") - 1
        offset = position - shard.begin[string]
        cuts = np.searchsorted(string, np.arange(len(m) + 1))
        for j, i in enumerate(m):
            found[i] = offset[cuts[j] : cuts[j + 1]]
    return found


def _ranges(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of adjacent offsets: first and last."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return list(zip(offsets[np.r_[0, cut + 1]].tolist(), offsets[np.r_[cut, len(offsets) - 1]].tolist()))


def merged_repeats(strings: DataFrame) -> DataFrame:
    """h, s, first, last: runs of repeated windows in each of the different strings (h, s, piece) of each key h.

    The strings of a key come to one task in a row; keys are merged together until MERGE_BYTES are held.
    """

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def flush(held: list[tuple]) -> Iterator[tuple]:
            for (h, s, _), offsets in zip(held, repeated([p for _, _, p in held])):
                for a, b in _ranges(offsets):
                    yield (h, s, a, b), 32

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            held, size, last = [], 0, None
            for row in rows:
                if row[0] != last and size >= MERGE_BYTES:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
            if held:
                yield from flush(held)

        return step

    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    ordered = strings.select("h", "s", "piece").repartition("h").sortWithinPartitions("h", "s")
    return row_map(ordered, "h bigint, s bigint, first bigint, last bigint", start, schema)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """uid, spans array<struct<a, b>> of bytes in repeats, for settled rows (uid, text binary) that have any. Spans may overlap."""
    found = settle(occurrences(rows))
    keys = settle(found.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("x"), F.max("s").alias("y")).filter("n > 1").select("h", "n", (F.col("x") != F.col("y")).alias("several")))
    met = settle(lookup(found, keys, ["h"], "n", ["uid", "start"]).drop("n"))
    several = met.filter("several")
    strings = settle(several.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("uid", "start", "size")).alias("at")))
    bulk = strings.groupBy("h").agg(F.sum("at.size").alias("bytes"), F.sum("n").alias("n")).filter(F.col("bytes") > KEY_BYTES).select("h", "n", F.lit(True).alias("wide"))
    bulk = settle(bulk)
    wide = not bulk.isEmpty()
    narrow = lookup(strings.withColumnRenamed("n", "copies"), bulk, ["h"], "n", ["s"], "left").filter("wide is null") if wide else strings.withColumnRenamed("n", "copies")
    wanted = narrow.groupBy("at.uid").agg(F.collect_list(F.struct("h", "s", "at.start", "at.size")).alias("pieces"))
    pieces = rows.join(wanted, "uid").select("text", F.explode("pieces").alias("p")).select("p.h", "p.s", F.expr("substring(text, int(p.start + 1), p.size)").alias("piece"))
    ends = [F.lit(0).cast("long").alias("first"), (F.col("at.size") - LENGTH).cast("long").alias("last")]
    runs_of = merged_repeats(pieces).union(narrow.filter("copies > 1").select("h", "s", *ends))
    runs_of = settle(runs_of.groupBy("h", "s").agg(F.collect_list(F.struct("first", "last")).alias("runs")).join(narrow.select("h", "s", "copies"), ["h", "s"]))
    part = lookup(several.drop("several"), runs_of, ["h", "s"], "copies", ["uid", "start"]).select("uid", "start", F.explode("runs").alias("r"))
    span = lambda a, b: (a.alias("a"), b.alias("b"))
    spans = met.filter(~F.col("several")).select("uid", *span(F.col("start"), F.col("start") + F.col("size")))
    spans = spans.union(part.select("uid", *span(F.col("start") + F.col("r.first"), F.col("start") + F.col("r.last") + LENGTH)))
    if wide:  # so many different strings that they would fill a task: their windows are counted one by one, added up before they move
        of_text = lookup(several.drop("several"), bulk, ["h"], "n", ["uid", "start"]).groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("strings"))
        windows = settle(windows_of(rows.join(of_text, "uid")))
        counted = settle(windows.groupBy("h", "s").agg(F.count("*").alias("n")).filter("n > 1"))
        spans = spans.union(lookup(windows, counted, ["h", "s"], "n", ["uid", "start"]).select("uid", *span(F.col("start"), F.col("start") + LENGTH)))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the bytes that lie in a string of LENGTH bytes that starts anywhere else too.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, text binary (the
    bytes as they were), kept binary (those left, which need not be whole characters), spans
    array<struct<a, b>> (maximal removed runs, end exclusive). Matches never cross rows, overlaps count,
    and the input is judged, not what is left. A null text is empty. Repeated rows repeat each other; very long
    texts are scanned whole, SCAN bytes at a time. An empty table gives none. Rows are written once, so that
    their numbers stay the same however often they are read.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")))
    joined = rows.join(repeated_spans(rows.select("uid", "text")), "uid", "left").select("doc_id", "text", "spans")

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text, spans in rows:
                out: list[dict] = []
                for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                    if out and a <= out[-1]["b"]:
                        out[-1]["b"] = max(b, out[-1]["b"])
                    else:
                        out.append({"a": a, "b": b})
                edges = [0, *(x for span in out for x in (span["a"], span["b"])), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield (doc_id, text, kept, out), 2 * len(text)

        return step

    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("kept", pa.binary()), ("spans", pa.list_(span))])
    return row_map(joined, "doc_id bigint, text binary, kept binary, spans array<struct<a: bigint, b: bigint>>", start, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
