"""MinHash near-duplicates with min-max hashing: each permutation gives its least and its largest value."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, row_map, settle, table, text_bytes
from tessera.llm.components import components
from tessera.llm.shingles import NEAR, mixed, shingle_set

#: Permutations, each of which gives two values; values of a band. A pair of similarity 0.75 meets in none of the 28 bands once in five million.
PERMUTATIONS, BAND = 42, 3
BANDS = 2 * PERMUTATIONS // BAND
#: Members of a bucket that one task compares, and bytes of their texts, about; larger buckets are dealt out in such parts.
PART, PART_BYTES = 2048, 16 << 20
#: Large buckets whose leaders go to every task at once, at most.
MANY = 10_000
_draw = np.random.default_rng(20)
_A = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
#: Values are dealt to bands so that the two of a permutation are apart.
_DEAL = np.arange(2 * PERMUTATIONS).reshape(BANDS, BAND)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values under all permutations, then the largest."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        h = np.multiply.outer(_A, shingles[i : i + 2048])
        h += _B[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the signature, told apart by the band's number."""
    values = signature(shingles)[_DEAL]
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return h.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash binary (128 bits of the sorted set), bands array<bigint> (empty without shingles)."""

    def start() -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text_hash, text in rows:
                s = shingle_set(text)
                bands = band_keys(s) if len(s) else []
                yield (doc_id, text_hash, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands), 300

        return step

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])
    return row_map(_keyed(docs), "doc_id bigint, text_hash bigint, n_shingles bigint, set_hash binary, bands array<bigint>", start, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_bytes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def links_within(sets: list[np.ndarray], known: list | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the same sets as all pairs of near copies would, and the component of each set. Sets equal in known are joined already.

    A pass compares one set, the first to begin with, with all others at once. Passes take sets outside the
    largest component, until no two sets of different components are left of which neither was compared with
    all: so no link is missed, and a bucket that is one component after few passes ends there.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    component = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    done = np.zeros(n, bool)
    found: list[tuple[int, int]] = []
    while len(np.unique(component[~done])) > 1:
        left = np.bincount(component, minlength=n)[component] * 1.0
        left[done] = np.inf
        i = int(left.argmin()) if done.any() else 0
        done[i] = True
        own = sets[i]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        inside = np.bincount(owner[own[at] == flat], minlength=n)
        near = 100 * inside >= NEAR * (sizes + len(own) - inside)
        near[i] = False
        others = np.flatnonzero(near & (component != component[i]))
        for c in np.unique(component[others]).tolist():
            found.append((i, int(others[component[others] == c][0])))
        joined = np.isin(component, np.append(component[others], component[i]))
        component[joined] = component[joined].min()
    return found, component


_FOUND = "band bigint, a bigint, b bigint, text_hash bigint"


def _compared(cells: DataFrame, keys: list[str], texts: DataFrame) -> DataFrame:
    """Links (a, b) within each cell of (keys, doc_id, text_hash, leads, known), and with b null the members of a led cell that no link joins to its leader."""
    rows = cells.join(texts, ["doc_id", "text_hash"]).select(*keys, "doc_id", "text_hash", "leads", "known", "text")

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("leads", "doc_id", "text_hash", "known", "text"))), key=lambda r: (not r[0], r[1:3]))
        own = {}
        for _, i, h, known, text in rows:  # the leader is the first
            own.setdefault((i, h), (known, text))
        names, band = list(own), group["band"][0].as_py()
        links, component = links_within([shingle_set(t) for _, t in own.values()], [k for k, _ in own.values()] if rows[0][3] is not None else None)
        out = [(band, names[x][0], names[y][0], None) for x, y in links]
        if rows[0][0]:
            out += [(band, *names[x][:1], None, names[x][1]) for x in np.flatnonzero(component != component[0]).tolist()]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("band", "a", "b", "text_hash"))})

    return rows.groupBy(*keys).applyInArrow(compare, _FOUND)


def near_links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) of doc_ids between representatives of different shingle sets, enough for all components.

    Representatives meet in buckets of equal band keys; buckets with the same members are kept once, and
    each is compared on full sets. A bucket larger than a part is dealt out: every part is compared within
    itself and with the bucket's leader. Members of different parts that are in the leader's component, by links
    of any bucket, need no comparison; those that are not, the rest, are compared with all parts.
    """
    classes = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    keyed = settle(classes.select("rep.*", "size", F.explode("bands").alias("band")))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("members"), F.sum("size").alias("words"), F.min(F.struct("doc_id", "text_hash")).alias("leader"), F.bit_xor(F.xxhash64("doc_id", "text_hash")).alias("x"), F.bit_xor(F.xxhash64("text_hash", "doc_id")).alias("y"))
    parts = F.greatest(F.ceil(F.col("members") / PART), F.ceil(F.col("words") * 8 / PART_BYTES)).cast("int")
    kept = settle(sizes.filter("members > 1").groupBy("members", "x", "y").agg(F.min(F.struct("band", parts.alias("parts"), "leader")).alias("k")).select("k.band", "members", "k.parts", "k.leader"))
    members = lookup(keyed, kept, ["band"], "members", ["doc_id", "text_hash"])
    members = settle(members.select("band", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")).cast("int").alias("part"), "parts", "doc_id", "text_hash"))
    texts = settle(_keyed(docs).join(members.select("doc_id", "text_hash").distinct().hint("merge"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")))
    large = kept.filter("parts > 1").select("band", "parts", "leader.doc_id", "leader.text_hash")
    leaders = large.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", "text_hash", F.lit(True).alias("leads"))
    first = members.select("band", "part", "doc_id", "text_hash", F.lit(False).alias("leads")).union(leaders).withColumn("known", F.lit(None).cast("bigint"))
    found = settle(_compared(first, ["band", "part"], texts))
    links = found.filter("b is not null").select("a", "b")
    if found.filter("b is null").isEmpty():
        return links
    labels = settle(components(links))
    label = lambda frame: frame.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("known", F.coalesce("component", "doc_id")).drop("component")
    ahead = label(large).select("band", "parts", F.col("known").alias("ahead"))
    rest = label(found.filter("b is null").select("band", F.col("a").alias("doc_id"), "text_hash"))
    rest = settle(rest.join(F.broadcast(ahead) if large.count() <= MANY else ahead, "band").filter("known <> ahead").select("band", "doc_id", "text_hash", "known"))
    stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if rest.isEmpty():
        return stars
    many = rest.groupBy("band").agg(F.count("*").alias("n")).join(large.select("band", "parts"), "band")
    many = settle(many.select("band", "n", "parts", F.ceil(F.col("n") / PART).cast("int").alias("cells")))
    cell = F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("cells")).cast("int")
    ones = lookup(rest, many, ["band"], "n", ["doc_id", "text_hash"]).select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), cell.alias("cell"), "doc_id", "text_hash", "known")
    others = lookup(members.drop("parts"), many.select("band", "cells", (F.col("parts") * PART).cast("bigint").alias("n")), ["band"], "n", ["doc_id", "text_hash"])
    others = label(others).select("band", "part", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "doc_id", "text_hash", "known")
    crossed = _compared(ones.unionByName(others).withColumn("leads", F.lit(False)), ["band", "part", "cell"], texts)
    return stars.union(crossed.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of at least 0.75.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, n_shingles,
    component_id (the least doc_id that links reach), kept (whether that is its own). Texts without words,
    or null, are linked with nothing. Rows of one doc_id are one document in the graph, whatever their texts.
    Very long texts are compared whole. A row without doc_id has the component of its shingle set, null if no row with an id shares the set,
    and is not kept. An empty table gives none.
    """
    sketches = settle(sketch(docs))
    labels = components(near_links(docs, sketches))
    classes = sketches.filter(F.col("n_shingles") > 0).groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(labels, classes.rep == labels.node, "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return (
        sketches.select("doc_id", "n_shingles", "set_hash")
        .join(classes, "set_hash", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", alone).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), o as (select doc_id, len(w) as n, unnest(w) as x, generate_subscripts(w, 1) as i from t),
f as (select doc_id, n, i, concat_ws(' ', x, lead(x, 1) over v, lead(x, 2) over v, lead(x, 3) over v, lead(x, 4) over v) as x from o window v as (partition by doc_id order by i)),
e as (select distinct doc_id, x from f where i <= greatest(n - 4, 1)),
n as (select t.doc_id, count(e.x) as n from t left join e on t.doc_id = e.doc_id group by t.doc_id),
s as (select * from e where x in (select x from e group by x having count(*) > 1)),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
h as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * k >= 75 * (x.n + y.n - k)),
l as (select a, b from h union all select b, a from h),
r as (select doc_id, component from (with recursive w(doc_id, component) as (select doc_id, doc_id from n union select l.b, w.component from w join l on l.a = w.doc_id) select doc_id, min(component) as component from w group by doc_id))
select n.doc_id, cast(n.n as bigint) as n_shingles, r.component as component_id, n.doc_id = r.component as kept from n join r on n.doc_id = r.doc_id
"""
