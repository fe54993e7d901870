"""Byte-level BPE encoding and decoding with a binary segment tree over byte positions."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kept, row_map, table

#: White space as Unicode has it (property White_Space), which is what the pattern's \s means to tiktoken.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs at whose ends the pattern always ends a match: a word with one blank before it, or white space.
UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries each worker keeps of units and pieces, the first that it meets; longer ones than KEPT_CHARS are not kept.
KEPT, KEPT_CHARS = 500_000, 48
#: What a leaf holds where no pair of live tokens with a rank starts.
NONE = 1 << 62


class Codec:
    """Encoder and decoder for one rank file. Ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern merged by itself."""
        ids: list[int] = []
        add, find = ids.extend, self.known.get
        for unit in UNIT.findall(text):
            add(find(unit) or self.unit(unit))
        return ids

    def unit(self, unit: str) -> tuple[int, ...]:
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            pieces = [unit]
        elif body[-1:] in ".,;:!?" and body[:-1].isalpha():
            pieces = [unit[:-1], unit[-1]]
        else:
            pieces = self.pattern.findall(unit)
        known = self.known
        ids: tuple[int, ...] = ()
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= KEPT_CHARS and len(known) < KEPT:
                    known[piece] = got
            ids += got
        if len(unit) <= KEPT_CHARS and len(known) < KEPT:
            known[unit] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match.

        The leaf at n + i of a binary tree over the n byte positions holds rank * n + i of the pair of live
        tokens that starts at i; every node above has the least of its two children, so the root is the
        leftmost pair of least rank. A merge is three point updates, each of a leaf and of the nodes above
        it as far as they change: the position, its live neighbour to the left, and the one that goes.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        get = ranks.get
        tree = [NONE] * (2 * n)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[n + i] = rank * n + i
        for k in range(n - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(at: int, rank: int | None) -> None:
            k = n + at
            least = NONE if rank is None else rank * n + at
            while k and tree[k] != least:
                tree[k] = least
                other = tree[k ^ 1]
                if other < least:
                    least = other
                k >>= 1

        after = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n - 1))
        while (least := tree[1]) < NONE:
            i = least % n
            j = after[i]
            end = after[i] = after[j]
            put(j, None)
            if end < n:
                before[end] = i
                put(i, get(piece[i : after[end]]))
            else:
                put(i, None)
            left = before[i]
            if left >= 0:
                put(left, get(piece[left:end]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: in each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _codec(path: str, pattern: str) -> Codec:
    return kept(f"{path} {pattern}", lambda: Codec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, round_trip: bool = True) -> DataFrame:
    """Token ids of every text, and the bytes that the ids decode to.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, ids
    array<int>, decoded binary (null without round_trip). A null or empty text has no ids and decodes
    to no bytes; repeated rows are encoded each; an empty table gives none. The rank file is read from
    its path by each worker, once.
    """

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        codec = _codec(path, pattern)

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                ids = codec.encode(text or "")
                yield (doc_id, np.array(ids, np.int32), codec.decode(ids) if round_trip else None), 4 * len(ids) + len(text or "")

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    doc_id = F.col("doc_id") if kind == "bigint" else F.col("doc_id").cast("string")
    return row_map(docs.select(doc_id.alias("doc_id"), "text"), f"doc_id {'bigint' if kind == 'bigint' else 'string'}, ids array<int>, decoded binary", start, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes of rows of doc_id and ids; null ids give null."""

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        codec = _codec(path, public_tokenizers.PATTERN)

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, ids in rows:
                out = None if ids is None else codec.decode(ids)
                yield (doc_id, out), len(out or b"")

        return step

    return row_map(encoded.select("doc_id", "ids"), "doc_id bigint, decoded binary", start, pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())]))


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode() returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
