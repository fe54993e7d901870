"""Ranked lexical search over shards, each indexed by a dual-sorted wavelet tree.

A shard is some thousand documents. The posting lists of its terms stand one behind the other, each by falling impact, and a
wavelet tree over their document numbers halves the documents at every level, keeping the order within. So a list's part in a
node is a range, the documents of a node can be told from the ranges, and the first posting of a range has the highest impact
of all below. For a query, the sum of these over its terms bounds every score in the node: nodes are opened in falling order
of bounds, until they fall below the k-th score. At the lowest level the bound is the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import row_map, settle, table

#: Bytes of terms as they are compared: A-Z in lower case, digits and all beyond ASCII; a blank for what separates terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and postings of a shard at most (a document more than that is a shard of its own), and terms of the queries that are searched at once, about.
SHARD_DOCS, SHARD_POSTINGS, QUERY_TERMS = 8192, 1 << 19, 1 << 16
#: Nodes opened at once after the first few, and ranges that the open nodes of a query may hold.
OPENED, RANGES = 256, 1 << 21
#: One in so many documents is searched first, for scores below which no task has to look.
FIRST = 32
#: Bytes of a text split at once.
CHUNK = 4 << 20


def term_counts(text: str, known: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, with repeats, and how often those that are known (by numbers from 1)."""
    data = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    n, found, at = 0, Counter(), 0
    while at < len(data):
        to = at + CHUNK
        if to < len(data):
            cut = data.rfind(b" ", at, to)
            to = cut if cut > at else data.find(b" ", to)
            to = len(data) if to < 0 else to
        words = data[at:to].split()
        n += len(words)
        found.update(filter(None, map(known.get, words)))
        at = to
    return n, found


class Tree:
    """Dual-sorted wavelet tree: lists of (document, impact) by term, documents numbered from 0."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order].astype(np.int32), impact[order]
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term)).astype(np.int64)
        self.levels = max(0, int(docs - 1).bit_length())
        n = len(doc)
        self.zeros = np.zeros((max(1, self.levels), n + 1), np.int32)  # of a level, zeros before each place
        self.impact = np.empty((self.levels + 1, n + 1), np.int64)
        self.impact[:, n] = 0
        for level in range(self.levels):
            self.impact[level, :n] = impact
            one = (doc >> (self.levels - 1 - level) & 1).astype(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            doc, impact = doc[order], impact[order]
        self.impact[self.levels, :n] = impact
        self.opened = 0

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of terms start and end; one that is not here is empty."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return np.where(here, self.starts[at], 0), np.where(here, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)

    def bounds(self, level: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = np.where(start < end, self.impact[level[:, None], start], 0)
        return first @ weights

    def children(self, level: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both halves of nodes: level, prefix, and ranges."""
        self.opened += len(level)
        zeros = self.zeros[level[:, None], start], self.zeros[level[:, None], end]
        behind = self.zeros[level, -1][:, None]
        left = zeros
        right = behind + start - zeros[0], behind + end - zeros[1]
        return np.tile(level + 1, 2), np.concatenate([2 * prefix, 2 * prefix + 1]), np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


class Best:
    """The k best (score, id) of a query, equal scores by the smaller id; scores from floor on."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, max(1, floor)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        here = scores >= self.floor
        scores, ids = np.concatenate([self.scores, scores[here]]), np.concatenate([self.ids, ids[here]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds to best the documents of a shard that belong there. ids: of the documents, by number."""
    start, end = tree.ranges(terms)
    here = start < end
    start, end, weights = start[here][None, :], end[here][None, :], weights[here]
    if not start.shape[1]:
        return
    zero = np.zeros(1, np.int64)
    # where a frontier would hold too many ranges, halves are searched one after the other, the better one first
    waiting = [(tree.bounds(zero, start, end, weights)[0], zero, zero, start, end)]
    while waiting:
        bound, level, prefix, start, end = waiting.pop()
        if bound < best.floor:
            continue
        if level[0] < tree.levels and start.shape[1] << int(tree.levels - level[0] + 1) > RANGES:
            level, prefix, start, end = tree.children(level, prefix, start, end)
            bounds = tree.bounds(level, start, end, weights)
            waiting += [(bounds[i], level[i : i + 1], prefix[i : i + 1], start[i : i + 1], end[i : i + 1]) for i in np.argsort(bounds, kind="stable").tolist()]
        else:
            _best_first(tree, weights, ids, best, np.array([bound]), level, prefix, start, end)


def _best_first(tree: Tree, weights: np.ndarray, ids: np.ndarray, best: Best, bounds: np.ndarray, *nodes: np.ndarray) -> None:
    width = 4
    while True:
        width = min(2 * width, OPENED)
        keep = bounds >= best.floor
        if not keep.any():
            return
        bounds, nodes = bounds[keep], [x[keep] for x in nodes]
        if len(bounds) > width:
            chosen = np.zeros(len(bounds), bool)
            chosen[np.argpartition(-bounds, width)[:width]] = True
        else:
            chosen = np.ones(len(bounds), bool)
        leaf = nodes[0] == tree.levels
        found = chosen & leaf
        if found.any():
            best.add(bounds[found], ids[nodes[1][found]])
        chosen &= ~leaf
        level, prefix, start, end = tree.children(*(x[chosen] for x in nodes))
        below = tree.bounds(level, start, end, weights)
        some = (below >= best.floor) & (prefix < len(ids))
        rest = ~(chosen | found)
        bounds = np.concatenate([bounds[rest], below[some]])
        nodes = [np.concatenate([x[rest], y[some]]) for x, y in zip(nodes, (level, prefix, start, end))]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term that a document has tf times adds, before its weight: whole numbers, divisions rounding down."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        m = 50 + (50 * n.astype(object) * docs // total).astype(np.int64)
    else:
        m = 50 + 50 * n * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document, with repeats), terms and tf (known terms by number, and how often)."""

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                n, found = term_counts(text or "", known)
                yield (doc_id, n, list(found), list(found.values())), 16 + 8 * len(found)

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
    return row_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>", start, arrow)


#: The id that stands for null while documents are compared: behind all others.
NO_ID = (1 << 63) - 1
HITS = "query int, doc_id bigint, score bigint"


def _hits(held: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int, docs: int, total: int) -> DataFrame:
    """The k best of each task for each query. Shards follow each other, so what is found in one cuts the search of the next short."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """ids and n of documents, and number of the document, term and tf of postings."""
        for batch in batches:
            counts = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(at + SHARD_DOCS, max(at + 1, int(np.searchsorted(ends, before + SHARD_POSTINGS, side="right"))), batch.num_rows)
                part = batch.slice(at, to - at)
                ids = part["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                # documents with equally many terms are next to each other, so that nodes differ
                order = np.argsort(counts[at:to], kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                yield ids[order], part["n"].to_numpy()[order], np.repeat(place, counts[at:to]), part["terms"].flatten().to_numpy(), part["tf"].flatten().to_numpy()
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, floors.get(q, 1)) for q in range(len(queries))]
        for ids, n, doc, term, tf in shards(batches):
            tree = Tree(term, doc, impacts(tf, n[doc], docs, total), len(ids))
            for (terms, weights), found in zip(queries, best):
                search(tree, terms, weights, ids, found)
        for q, found in enumerate(best):
            if len(found.ids):
                ids = pa.array(found.ids, mask=found.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), ids, pa.array(found.scores)], ["query", "doc_id", "score"])

    return held.filter("size(terms) > 0").select("doc_id", "n", "terms", "tf").mapInArrow(run, HITS)


def _search_block(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """item_id, rank, doc_id and score for a block of queries (item_id, terms)."""
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(t.encode(), len(known) + 1) for t in row.terms], np.int64) for row in asked]
    held = settle(postings(docs, known))
    n, total = held.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    df = np.zeros(len(known) + 1, np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms at most
        df[r[0]] = r[1]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = [(terms[df[terms] > 0], weight[terms[df[terms] > 0]]) for terms in numbers]
    queries = [(terms[w > 0], w[w > 0]) for terms, w in queries]
    first = _hits(held.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(FIRST)) == 0), queries, {}, k, n, total)
    ranked = lambda frame, *keys: frame.withColumn("rank", F.row_number().over(Window.partitionBy("query", *keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    floors = {r.query: r.score for r in ranked(first).filter(F.col("rank") == k).collect()}  # one a query
    found = _hits(held, queries, floors, k, n, total).withColumn("part", F.spark_partition_id() % 256)
    best = settle(ranked(ranked(found, "part").drop("rank"))).select("query", "rank", "doc_id", "score")
    names = docs.sparkSession.createDataFrame([(i, row.item_id) for i, row in enumerate(asked)], "query int, item_id bigint")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k documents of the highest scores above 0 for each query: item_id, rank, doc_id, score.

    docs: doc_id, text; queries: item_id, text; other columns are ignored. Every row of queries is a query of its own (with repeated ids
    ranks repeat), every row of docs a document (repeated ones count and rank each). Equal scores are in order of doc_id, a null one last. A null
    or empty text has no terms: such a document is not counted, such a query has no rows. Queries go to the tasks in blocks of about
    QUERY_TERMS terms, each of which reads the documents once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)")))
    asked = settle(queries.select(F.col("item_id").cast("bigint").alias("item_id"), terms.alias("terms")).filter("size(terms) > 0"))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        found = _search_block(docs, rows, k) if rows else None
        out = out if found is None else out.union(found)
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (
  select row_number() over () as id, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), p as (
  select id, doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term, count(*) as tf from d group by all
), n as (
  select id, cast(sum(tf) as bigint) as n from p group by id
), g as (
  select count(*) as docs, cast(sum(n) as bigint) as total from n
), q as (
  select distinct item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark
), w as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, g group by term
), s as (
  select q.item_id, p.id, p.doc_id, cast(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * n.n * g.docs) // g.total)))) as bigint) as score
  from q join p using (term) join w using (term) join n on n.id = p.id, g group by all
), r as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
)
select item_id, rank, doc_id, score from r where rank <= 50
"""
