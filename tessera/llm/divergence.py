"""Audit of sources: how far the words of each (language, source) group are from those of its language and of its other sources.

Texts go through a byte-level tokenizer: a lookup table over the concatenated UTF-8 buffer of a batch gives each byte's lower
case or zero, and the places where zero ends and begins are the terms' bounds. Terms are grouped by xxhash, and every one is
compared with its group's first byte by byte. Counts are compressed sparse rows, one of documents in a task and one of sources
in a block of terms, and divergences are sums over their rows by reduceat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, settle, table

#: Documents that a kept term is in at least, and terms named for a group.
LEAST_DOCS, TERMS = 3, 200
#: What probabilities are multiplied by to be whole numbers.
SCALE = 1_000_000_000
#: Bytes of text tokenized at once, and counts or bytes of text from which a task sends on what it has gathered.
CHUNK, GATHERED, GATHERED_BYTES = 4 << 20, 2_000_000, 64 << 20
#: Counts of a block of terms, about, and sources that a block compares with all others at once.
BLOCK, TILE = 1 << 15, 256
#: The lower-case byte of letters A-Z, the byte itself of a-z and of all beyond ASCII, zero for what separates terms.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in a buffer of looked-up bytes; none crosses an offset at which a text begins."""
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms and the number of each slice's term."""
    data = low.tobytes()
    n = len(starts)
    hashes = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    like = first[number]
    if (lengths == lengths[like]).all():
        before = np.repeat(np.cumsum(lengths) - lengths, lengths)
        along = np.arange(len(before)) - before
        same = bool((low[np.repeat(starts, lengths) + along] == low[np.repeat(starts[like], lengths) + along]).all())
    else:
        same = False
    if same:
        return [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], number
    known: dict[bytes, int] = {}  # two terms share a hash
    number = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
    return list(known), number


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


class Gathered:
    """Counts of a task: groups and terms by number, occurrences and documents of each pair of them."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.read = 0

    def add(self, texts: pa.Array, groups: list[tuple[str, str]]) -> None:
        own = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups])
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        low = LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        self.read += len(low)
        starts, ends = bounds(low, offsets)
        if not len(starts):
            return
        terms, number = grouped(low, starts, ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        cells, counts = np.unique(doc * len(terms) + number, return_counts=True)  # the rows of documents
        ids = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms])
        keys, n, docs = _summed(own[cells // len(terms)] << 32 | ids[cells % len(terms)], counts, np.ones(len(cells), np.int64))
        self.parts.append((keys, n, docs))
        self.size += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n, docs, and a row without a term for each group."""
        names = list(self.groups)
        if not names:
            return
        keys, n, docs = _summed(*(np.concatenate(c) for c in zip(*self.parts))) if self.parts else (np.zeros(0, np.int64),) * 3
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = pa.array([g[0] for g in names]), pa.array([g[1] for g in names])
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(np.zeros(len(names), np.int64))], COUNTED)
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            g = pa.array(keys[part] >> 32)
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(pa.array(keys[part] & 0xFFFFFFFF)), pa.array(n[part]), pa.array(docs[part])], COUNTED)


COUNTED = ["lang", "source", "term", "n", "docs"]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about CHUNK bytes of text at a time."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield batch.slice(at, to - at)
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """Per (lang, source, term), in parts that are still to be added up: n occurrences in docs documents; term null once or more for each group.

    docs: text, lang, source, of which nulls are empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for part in _pieces(batch):
                held.add(part["text"], list(zip(part["lang"].to_pylist(), part["source"].to_pylist())))
                if held.size >= GATHERED or held.read >= GATHERED_BYTES:
                    yield from held.rows()
                    held = Gathered()
        yield from held.rows()

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*empty).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def chance(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), exact."""
    return F.expr(f"1 + (({SCALE} * cast({n} + 1 as decimal(20, 0))) div cast({total} + {v} as decimal(20, 0)))")


def distances(source: np.ndarray, term: np.ndarray, p: np.ndarray, absent: np.ndarray, v: int, rows: np.ndarray) -> np.ndarray:
    """For each of rows, the sum over v terms of floor((p - q)^2 / q), q being the p of each source in turn.

    source and term (numbers), p: entries in order of source; absent: each source's p of a term that it does not have.
    """
    s = len(absent)
    has = np.bincount(source, minlength=s)
    full = np.flatnonzero(has)
    at = (np.cumsum(has) - has)[full]

    def by_source(values: np.ndarray) -> np.ndarray:
        out = np.zeros(s, np.int64)
        if len(full):
            out[full] = np.add.reduceat(values, at)
        return out

    first = np.cumsum(has) - has
    out = np.empty((len(rows), s), np.int64)
    own_absent = absent[source]
    for i, a in enumerate(rows.tolist()):
        mine = slice(first[a], first[a] + has[a])
        dense, there = np.full(v, absent[a]), np.zeros(v, bool)
        dense[term[mine]], there[term[mine]] = p[mine], True
        met = dense[term]
        both = there[term]
        theirs = by_source((met - p) ** 2 // p)  # terms that the other has
        values, times = np.unique(p[mine], return_counts=True)
        only = np.zeros(s, np.int64)  # terms that this one has, as if the other had none of them
        for value, n in zip(values.tolist(), times.tolist()):
            only += n * ((value - absent) ** 2 // absent)
        shared = by_source(np.where(both, (met - own_absent) ** 2 // own_absent, 0))
        neither = v - has[a] - has + by_source(both.astype(np.int64))
        out[i] = theirs + only - shared + neither * ((absent[a] - absent) ** 2 // absent)
    return out


PAIRS = "lang string, source string, item string, value bigint"


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Partial sums for each pair of sources of a language, from each block of terms.

    entries: lang, source, term, p, blocks, tiles; groups: lang, source, absent, blocks, tiles. A block has the entries of terms with one
    hash; with more than TILE sources it is compared tile by tile.
    """
    tiles = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile")
    left = entries.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), tiles, "source", "term", "p")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("lang", "block", tiles, "tiles", "source", "absent")

    def compare(held: pa.Table, all_: pa.Table) -> pa.Table:
        all_ = all_.sort_by("source")
        names = all_["source"].combine_chunks()
        source = pc.index_in(held["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = held["term"].combine_chunks().dictionary_encode()
        order = np.argsort(source, kind="stable")
        rows = np.arange(len(names))
        rows = rows[rows % all_["tiles"][0].as_py() == all_["tile"][0].as_py()]
        values = distances(source[order], terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], held["p"].to_numpy()[order], all_["absent"].to_numpy(), len(terms.dictionary), rows)
        a, b = np.repeat(rows, len(names)), np.tile(np.arange(len(names)), len(rows))
        other = a != b
        lang = pa.array([all_["lang"][0].as_py()] * int(other.sum()), pa.string())
        return pa.table({"lang": lang, "source": names.take(pa.array(a[other])), "item": names.take(pa.array(b[other])), "value": values.ravel()[other]})

    return left.groupBy("lang", "block", "tile").cogroup(right.groupBy("lang", "block", "tile")).applyInArrow(compare, PAIRS)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """Divergences of every (lang, source) group: lang, source, part, item, value, rank.

    docs: text, lang, source, of which nulls are empty; other columns are ignored; repeated rows are documents each. Terms are runs of
    letters and of bytes beyond ASCII, with A-Z in lower case; a language keeps those in at least least_docs of its documents. With n
    occurrences of N a term's p is 1 + floor(10^9 (n + 1) / (N + V)), V being the language's kept terms. Part `pair` has a row for each
    other source of the language, its value the sum over kept terms of floor((p - q)^2 / q), q the other's p (0 without kept terms); part
    `term` the group's terms that are likelier than in the language, the highest `terms` of them. Equal values are in order of the
    item's bytes. An empty table gives no rows, a language of one source no pairs. Sums have 64 bits, which p of 10^9 allows.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"all_docs": F.sum("docs").over(same), "total": F.sum("n").over(same), "turn": F.row_number().over(same.orderBy("source"))})
    kept = settle(counts.filter(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "n", "total", F.when(F.col("term").isNotNull() & (F.col("turn") == 1), 1).otherwise(0).alias("one")))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count("term").alias("entries"), F.sum("one").alias("ones"))
    langs = groups.groupBy("lang").agg(F.sum("own_total").alias("lang_total"), F.sum("ones").alias("v"), F.sum("entries").alias("all_entries"), F.count("*").alias("sources"))
    groups = groups.join(langs, "lang").select(
        "lang", "source", "own_total", "entries", "lang_total", "v",
        F.when(F.col("v") > 0, F.expr(f"1 + ({SCALE} div (own_total + v))")).otherwise(1).alias("absent"),
        F.ceil(F.greatest(F.col("all_entries"), F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.col("sources") / TILE).alias("tiles"),
    )
    groups = settle(groups)
    entries = lookup(kept.filter(F.col("term").isNotNull()).select("lang", "source", "term", "n", "total"), groups, ["lang", "source"], "entries", ["term"])
    entries = settle(entries.select("lang", "source", "term", chance("n", "own_total", "v").alias("p"), chance("total", "lang_total", "v").alias("q"), "blocks", "tiles"))
    ranked = lambda frame: frame.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(_pairs(entries, groups).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    high = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    columns = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(ranked(high).filter(F.col("rank") <= terms), "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (
  select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id from documents
), w as (
  select lang, source, id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), c as (
  select lang, source, term, count(*) as n, count(distinct id) as docs from w group by all
), k as (
  select lang, term, sum(n) as n from c group by all having sum(docs) >= 3
), g as (
  select distinct lang, source from d
), l as (
  select g.lang, any_value(coalesce(v, 0)) as v, any_value(coalesce(n, 0)) as n
  from g left join (select lang, count(*) as v, sum(n) as n from k group by lang) using (lang) group by g.lang
), s as (
  select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join (c semi join k using (lang, term)) as c using (lang, source) group by all
), p as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.n + l.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.n + l.v) as q
  from s join l using (lang) join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term
), f as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source join l on l.lang = a.lang and l.v = 0
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q
), r as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from f
)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
