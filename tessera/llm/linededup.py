"""Line dedup within one edit by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line is the same or one edit away (one character put in, left out or changed).
Variants of a line are all that one deletion makes of it, as hashed keys. Two lines of equal length are one
edit apart if they share a variant at the same place, so all lines of such a key are copies of each other
and the earliest stands for them; a line and one that is a character longer are if a variant of the longer is
the shorter. Hence no pairs within a key are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, settle, table

#: Lines of fewer characters have no edited copies; characters that are cut off both ends before lines are compared.
MIN_CHARS, CUT = 25, " \t\r"
#: Variants differ from their line within a block of so many characters; what is before and behind it is hashed once.
BLOCK = 64
LAST = (1 << 63) - 1


def _half_keys(line: Column, m: Column) -> list[Column]:
    """Hashes of the first half and of the rest as a line of n characters has them, for n its length and one less.

    Lines one edit apart share one of them, n being the length of the shorter.
    """
    keys = []
    for n in (m, m - 1):
        p = F.floor(n / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), n, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit("rest"), n, F.substring(line, m - (n - p) + 1, n - p))]
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    """oid, th and text of every text; oid and th tell document and text."""
    return docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("oid"), F.xxhash64("text").alias("th"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """oid, th, pos and line, as compared, of every line."""
    rows = _texts(docs).select("oid", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("oid", "th", "pos", F.btrim("line", F.lit(CUT)).alias("line")).withColumns({"m": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _pieces(text: Column) -> Column:
    """A text cut every BLOCK characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _running(pieces: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... pieces, each made from the one before."""
    return F.aggregate(pieces, F.array(F.lit(0).cast("bigint")), lambda done, piece: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), piece))))


def _variants(candidates: DataFrame) -> DataFrame:
    """id, role, key, place: a row for each block of a line as the shorter one (role 0), two for each deletion: by the shorter line that it makes (1), and by place (2).

    What is behind a block is cut every BLOCK characters from the block's end on, in the shorter line from one character before, so both
    cuts of a line give the hashes behind all of its blocks.
    """
    pieces, shifted = _pieces(F.col("line")), _pieces(F.substring(F.col("line"), F.lit(BLOCK), F.col("m")))
    from_right = lambda cut: F.reverse(_running(F.reverse(cut)))
    parts = F.arrays_zip(_running(pieces).alias("before"), pieces.alias("middle"), F.slice(from_right(pieces), F.lit(2), F.size(pieces) + 1).alias("behind"), from_right(shifted).alias("behind_short"))
    # a row holds its own block alone
    block = candidates.select("id", "m", "low", "high", F.posexplode(parts).alias("b", "x")).filter(F.col("b") <= F.col("m") / BLOCK)
    none = F.lit(0).cast("bigint")
    block = block.select("id", "m", "low", "high", "b", "x.before", F.coalesce("x.middle", F.lit("")).alias("middle"), F.coalesce("x.behind", none).alias("behind"), F.coalesce("x.behind_short", none).alias("behind_short"))
    short = F.xxhash64("b", "before", F.substring("middle", 1, BLOCK - 1), "behind_short")

    def deleted(i: Column) -> Column:
        rest = F.xxhash64("b", "before", F.concat(F.substring(F.col("middle"), F.lit(1), i), F.substring(F.col("middle"), i + 2, F.lit(BLOCK))), "behind")
        place = F.col("b") * BLOCK + i
        return F.when(
            (place >= F.col("low")) & (place <= F.col("high")),
            F.array(F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit("shorter"), F.col("m") - 1, rest).alias("key"), place.alias("place")), F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit("place"), F.col("m"), place, rest).alias("key"), place.alias("place"))),
        )

    inner = F.when(F.length("middle") > 0, F.flatten(F.array_compact(F.transform(F.sequence(F.lit(0), F.length("middle") - 1), deleted))))
    own = F.array(F.struct(F.lit(0).alias("role"), F.xxhash64(F.lit("shorter"), F.col("m"), short).alias("key"), F.lit(-1).alias("place")))
    return block.select("id", F.explode(F.concat(own, F.coalesce(inner, F.array_except(own, own)))).alias("v")).select("id", "v.*")


def _near(first: DataFrame) -> DataFrame:
    """h1, h2 of lines with an earlier line one edit away."""
    halves = first.select("h1", "h2", F.posexplode(F.array("k1", "k2", "k3", "k4")).alias("side", "half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("half")
    sides = halves.join(shared, "half").groupBy("h1", "h2").agg(F.max((F.col("side") % 2 == 0).cast("int")).alias("first_same"), F.max((F.col("side") % 2 == 1).cast("int")).alias("rest_same"))
    return sides


def _dropped(docs: DataFrame, first: DataFrame) -> DataFrame:
    wanted = first.join(_near(first), ["h1", "h2"])
    wanted = wanted.groupBy("oid", "th").agg(F.collect_list(F.struct("pos", "m", "h1", "h2", "first_same", "rest_same")).alias("w"))
    found = _texts(docs).join(wanted, ["oid", "th"]).select("oid", "th", F.split("text", "\n").alias("lines"), F.explode("w").alias("w")).select("oid", "th", "w.*", F.btrim(F.get("lines", F.col("w.pos")), F.lit(CUT)).alias("line"))
    m = F.col("m")
    low = F.when(F.col("rest_same") == 1, F.lit(0)).otherwise(F.floor((m - 1) / 2).cast("int"))
    high = F.when(F.col("first_same") == 1, m - 1).otherwise(F.floor(m / 2).cast("int"))
    candidates = settle(found.dropDuplicates(["h1", "h2"]).select("oid", "th", "pos", "line", "m", "h1", "h2", low.alias("low"), high.alias("high"), F.xxhash64("oid", "th", "pos").alias("id")))
    key = Window.partitionBy("key")
    met = _variants(candidates).withColumns({"x": F.min("id").over(key), "y": F.max("id").over(key)}).filter("x <> y").groupBy("key", "role", "id").agg(F.min("place").alias("place"))
    order = F.struct("oid", "th", "pos", "id", "place")
    met = met.join(candidates.select("id", "oid", "th", "pos"), "id").select("key", "role", "id", "place", order.alias("at"))
    by_role = [F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"r{r}") for r in range(3)]
    pairs = met.join(met.groupBy("key").agg(*by_role), "key")
    against = F.when(F.col("role") == 0, F.col("r1")).when(F.col("role") == 1, F.col("r0")).otherwise(F.col("r2"))
    pairs = pairs.withColumn("earlier", against).filter("earlier < at").select("id", "place", F.col("earlier.place").alias("there"), F.col("earlier.id").alias("earlier")).distinct()
    texts = candidates.select("id", "line", "h1", "h2")
    checked = pairs.join(texts, "id").join(texts.select(F.col("id").alias("earlier"), F.col("line").alias("other")), "earlier")
    # one edit apart: equal without the characters at these places (none, -1, of the shorter line)
    without = lambda line, place: F.when(place < 0, line).otherwise(F.concat(F.substring(line, F.lit(1), place), F.substring(line, place + 2, F.length(line))))
    same = without(F.col("line"), F.col("place")) == without(F.col("other"), F.col("there"))
    return checked.filter(same).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, exact_chars: int = 1) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals.

    docs: doc_id, text and any others. Returns all columns of each row with text holding the lines that
    stay, and n_lines and n_removed long, which take the place of columns of these names; no other name
    matters. Very long texts and lines are treated whole. Lines end at a line feed and are compared without blanks, tabs and
    carriage returns at both ends; empty lines stay (and those of fewer than exact_chars characters), those of fewer than
    MIN_CHARS go only where an earlier line is the same: one edit in them is more than a small change. Earlier is by doc_id (null last), then by place. A null
    text stays null and has no lines. Repeated rows are one document and keep the same lines. An empty table
    gives none.
    """
    lines = _lines(docs)
    long = lines.filter(F.col("m") >= MIN_CHARS)
    keys = _half_keys(F.col("line"), F.col("m"))
    at = F.min(F.struct("oid", "th", "pos", "k1", "k2", "k3", "k4", "m"))
    spots = F.count("*")
    first = settle(long.withColumns({f"k{i + 1}": k for i, k in enumerate(keys)}).groupBy("h1", "h2").agg(at.alias("f"), spots.alias("n")).select("h1", "h2", "n", "f.*"))
    near = _dropped(docs, first).withColumn("near", F.lit(True))
    fate = first.select("h1", "h2", "n", "oid", "th", "pos").join(near, ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", "n", "near", F.struct("oid", "th", "pos").alias("kept"))
    if exact_chars < MIN_CHARS:
        short = lines.filter((F.col("m") >= exact_chars) & (F.col("m") < MIN_CHARS))
        short = short.groupBy("h1", "h2").agg(F.min(F.struct("oid", "th", "pos")).alias("kept"), spots.alias("n")).filter("n > 1")
        fate = fate.unionByName(short.select("h1", "h2", "n", F.lit(None).cast("boolean").alias("near"), "kept"))
    gone = (F.col("m") >= exact_chars) & F.col("kept").isNotNull() & (F.coalesce("near", F.lit(False)) | (F.col("kept") != F.struct("oid", "th", "pos")))
    flags = lookup(lines.select("oid", "th", "pos", "m", "h1", "h2"), settle(fate), ["h1", "h2"], "n", ["oid", "th", "pos"], "left").select("oid", "th", "pos", gone.alias("gone"))
    flags = flags.groupBy("oid", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "gone"))).alias("flags")).filter(F.exists("flags", lambda x: x.gone)).select("oid", "th", F.transform("flags", lambda x: x.gone).alias("gone"))
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("oid"), F.xxhash64("text").alias("th"))
    joined = own.join(flags, ["oid", "th"], "left")
    before = F.col("row.text")
    n_lines = F.when(before.isNull(), F.lit(0)).otherwise(F.size(F.split(before, "\n"))).cast("long")
    kept = F.filter(F.split(before, "\n"), lambda line, i: ~F.get(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), before).otherwise(F.array_join(kept, "\n"))
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("gone", lambda x: x))).cast("long")
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in others], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as raw, generate_subscripts(ls, 1) as pos from d),
t as (select doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) as f from l),
a as (select f, min(row(doc_id, pos)) as first from t where f <> '' group by f),
v as (select f, first, i, hash(length(f) - 1, substr(f, 1, i - 1) || substr(f, i + 1)) as k from (select f, first, unnest(range(1, length(f) + 1)) as i from a where length(f) >= 25)),
p as (select x.f, y.first as other, y.f as g from v x join v y on x.k = y.k and x.i = y.i and y.first < x.first
  union select v.f, a.first, a.f from v join a on length(a.f) >= 25 and v.k = hash(length(a.f), a.f) and a.first < v.first
  union select a.f, v.first, v.f from v join a on length(a.f) >= 25 and v.k = hash(length(a.f), a.f) and v.first < a.first),
n as (select distinct f from p where levenshtein(f, g) <= 1),
g as (select t.doc_id, t.pos, t.raw, a.f is not null and (n.f is not null or a.first <> row(t.doc_id, t.pos)) as gone
  from t left join a on t.f = a.f left join n on t.f = n.f),
r as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as text from g group by doc_id)
select d.doc_id, cast(coalesce(r.n_lines, 0) as bigint) as n_lines, cast(coalesce(r.n_removed, 0) as bigint) as n_removed, case when d.text is not null then r.text end as text
from d left join r on d.doc_id = r.doc_id
"""
