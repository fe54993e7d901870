"""Queries of retrieval and its measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import retrieval as rt
from tessera.plans.base import frame, table
from tessera.shared import written

#: Questions: the first sentence of the documents whose number is a multiple of 25 and that have a vector.
QUESTIONS = "select d.doc_id as query_id, substring_index(d.text, '.', 1) as question, e.embedding as vector from documents d join embeddings e on d.doc_id = e.vec_id where d.doc_id % 25 = 0"
QUESTIONS_SQL = "select d.doc_id as query_id, split_part(d.text, '.', 1) as question, e.embedding as vector from documents d join embeddings e on d.doc_id = e.vec_id where d.doc_id % 25 = 0"
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN]+'), lambda w: w <> '')"
CTE = f"""
q as ({QUESTIONS_SQL}),
w as (select doc_id as id, {_TOKENS.format('text')} as w from documents),
p as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest(w) as term from w) group by id, term),
st as (select count(*) as n, avg(dl) as avgdl from (select distinct id, dl from p)),
t as (select query_id, unnest(list_distinct({_TOKENS.format('question')})) as term from q),
df as (select term, count(*) as df from p where term in (select term from t) group by term),
bs as (select t.query_id, p.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from t join df using (term) join p using (term), st group by 1, 2),
b as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bs qualify rank <= 60),
ds as (select q.query_id, e.vec_id as id, round(list_cosine_similarity(q.vector, e.embedding), 9) as score from q join embeddings e on q.query_id <> e.vec_id),
d as (select *, row_number() over (partition by query_id order by score desc, id) as rank from ds qualify rank <= 60),
fs as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) as score from (select query_id, id, rank from b union all select query_id, id, rank from d) group by 1, 2),
f as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fs qualify rank <= 30),
wt as (select t.query_id, t.term, ln(1 + n / (1 + coalesce(df.df, 0))) as w from t left join df on t.term = df.term, (select count(distinct id) as n from p)),
rs as (select f.query_id, f.id, f.score as fused, round(coalesce(sum(wt.w) filter (p.term is not null), 0) / sum(wt.w), 6) as score from f join wt on f.query_id = wt.query_id left join p on p.id = f.id and p.term = wt.term group by 1, 2, 3),
r as (select *, row_number() over (partition by query_id order by score desc, fused desc, id) as rank from rs qualify rank <= 10)
"""


def _inputs(spark, sf_dir):
    questions = written(frame(spark, sf_dir, QUESTIONS))  # a search reads them several times
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return questions, chunks, vectors


def bm25(spark, sf_dir):
    questions, chunks, _ = _inputs(spark, sf_dir)
    return rt.bm25(questions, rt.build(chunks), 60).select("query_id", "id", "score", "rank")


def dense(spark, sf_dir):
    questions, _, vectors = _inputs(spark, sf_dir)
    return rt.dense(questions, vectors, 60).select("query_id", "id", "rank")


def fused(spark, sf_dir):
    questions, chunks, vectors = _inputs(spark, sf_dir)
    return rt.fuse(rt.dense(questions, vectors, 60), rt.bm25(questions, rt.build(chunks), 60), limit=30).select("query_id", "id", "score", "rank")


def hybrid(spark, sf_dir):
    questions, chunks, vectors = _inputs(spark, sf_dir)
    return rt.hybrid(questions, chunks, vectors).select("query_id", "id", "score", "fused", "rank")


def recall(spark, sf_dir):
    questions, _, vectors = _inputs(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = rt.dense(questions, vectors, 10)
    known = hits.join(labels.select(F.col("vec_id").alias("id"), "label"), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    ranks = ev.first_rank(known, F.col("label") == F.col("own")).join(labels.select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 5, "domain").otherwise("general").alias("segment")), "query_id")
    return ev.recall_and_mrr(ranks, "segment")


RECALL_SQL = f"""
with {CTE}, h as (select d.*, c.label, o.label as own from d join embeddings c on c.vec_id = d.id join embeddings o on o.vec_id = d.query_id where d.rank <= 10),
k as (select query_id, min(rank) filter (label = own) as first, case when any_value(own) < 5 then 'domain' else 'general' end as segment from h group by query_id)
select segment, count(*) as n, {', '.join(f'round(avg(coalesce(cast(first <= {k} as int), 0)), 6) as recall_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr from k group by rollup (segment)
"""


def confusion(spark, sf_dir):
    questions, _, vectors = _inputs(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    known = rt.dense(questions, vectors, 5).join(labels.select(F.col("vec_id").alias("id"), "label"), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return ev.confusion_rate(known, F.col("label") == F.col("own"))


CONFUSION_SQL = f"with {CTE}, h as (select c.label <> o.label as outside from d join embeddings c on c.vec_id = d.id join embeddings o on o.vec_id = d.query_id where d.rank <= 5) select count(*) as hits, cast(sum(outside::int) as bigint) as outside, round(sum(outside::int) / count(*), 6) as rate, round(sum(outside::int) / count(*), 6) >= 0.15 as warn from h"


def dispersion(spark, sf_dir):
    return ev.dispersion(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), "label")


DISPERSION_SQL = """
with c as (select a.label, list_dot_product(a.embedding::double[64], b.embedding::double[64]) as c from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id),
n as (select label, count(*) as n from embeddings group by label)
select c.label, any_value(n.n) as n, round(avg(c), 6) as mean_cosine, round(stddev_pop(c), 6) as std_cosine, avg(c) >= 0.85 as warn from c join n on c.label = n.label group by c.label
""".replace("::double[64]", "")


def shares(spark, sf_dir):
    return ev.share_of_total(table(spark, sf_dir, "documents"), "source")


def siblings(spark, sf_dir):
    questions, _, _ = _inputs(spark, sf_dir)
    chunks = _windows(spark, sf_dir)
    index = rt.build(chunks.select("id", "content"))
    hits = rt.bm25(questions, index, 3)
    parts = rt.expand_siblings(hits, chunks)
    return parts.select("query_id", "document_id", "heading_path", "part_index", F.md5("content").alias("content_md5"))


def _windows(spark, sf_dir):
    """Chunks of a fixed length of 800 characters, one after the other, under the document's source as heading."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter(F.length("text") > 0)
    parts = docs.withColumn("part_index", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 800).cast("int"))))
    content = F.substring(F.col("text"), (F.col("part_index") - 1) * 800 + 1, F.lit(800))
    return parts.select((F.col("doc_id") * 100000 + F.col("part_index")).alias("id"), F.col("doc_id").alias("document_id"), F.col("source").alias("heading_path"), "part_index", F.ceil(F.length("text") / 800).cast("int").alias("part_total"), content.alias("content"))


SIBLINGS_SQL = f"""
with c as (select doc_id * 100000 + i as id, doc_id as document_id, source as heading_path, i as part_index, substr(text, (i - 1) * 800 + 1, 800) as content from (select *, unnest(range(1, cast(ceil(length(text) / 800) as bigint) + 1)) as i from documents)),
q as ({QUESTIONS_SQL}), w as (select id, {_TOKENS.format('content')} as w from c),
p as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest(w) as term from w) group by id, term),
st as (select count(*) as n, avg(dl) as avgdl from (select distinct id, dl from p)),
t as (select query_id, unnest(list_distinct({_TOKENS.format('question')})) as term from q),
df as (select term, count(*) as df from p where term in (select term from t) group by term),
bs as (select t.query_id, p.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from t join df using (term) join p using (term), st group by 1, 2),
b as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bs qualify rank <= 3),
h as (select b.query_id, c.document_id, c.heading_path, arg_min(c.part_index, b.rank) as hit from b join c on c.id = b.id group by 1, 2, 3)
select distinct h.query_id, h.document_id, h.heading_path, cast(c.part_index as int) as part_index, md5(c.content) as content_md5 from h join c using (document_id, heading_path) where abs(c.part_index - h.hit) <= 2
"""


def context(spark, sf_dir):
    one = table(spark, sf_dir, "conversations").withColumn("section", F.concat_ws(": ", "role", "text"))
    joined = one.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "section"))), lambda x: x.section), "\n\n---\n\n").alias("context"))
    return joined.select("conv_id", F.md5(rt.fit_budget(F.col("context"), 120)).alias("context_md5"), F.size(F.split("context", "\n\n---\n\n")).alias("sections"))


CONTEXT_SQL = r"""
with recursive s as (select conv_id, turn, role || ': ' || text as section, row_number() over (partition by conv_id order by turn, role || ': ' || text) as i from conversations),
c as (select conv_id, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as context, count(*) as n from s group by conv_id),
w as (select conv_id, cast(0 as bigint) as i, cast(0 as bigint) as used, cast([] as varchar[]) as kept from c
  union all select w.conv_id, w.i + 1, case when used + greatest(1, length(section) // 2) <= 120 then used + greatest(1, length(section) // 2) else used end, case when used + greatest(1, length(section) // 2) <= 120 then list_append(kept, section) else kept end
  from w join s on s.conv_id = w.conv_id and s.i = w.i + 1),
l as (select conv_id, arg_max(kept, i) as kept from w group by conv_id)
select c.conv_id, md5(case when length(context) // 2 <= 120 then context when len(kept) = 0 then substr(context, 1, 240) else array_to_string(kept, chr(10) || chr(10) || '---' || chr(10) || chr(10)) end) as context_md5, cast(n as int) as sections from c join l on c.conv_id = l.conv_id
"""


def filters(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("service_code"), F.col("source").alias("document_id"), F.lit(1).alias("start_page"), (F.col("n_chars") / 800).cast("int").alias("end_page"), F.col("text").alias("content"))
    return rt.chunk_filter(chunks, service_code="en", start_page=1, end_page=4, include=["the", "and"], exclude=["License"]).select("id", "end_page")


def parts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("part_index"), F.count("*").over(w).alias("part_total"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("seq"))


QUERIES = {
    "hybrid_retrieval": (hybrid, f"with {CTE} select query_id, id, score, fused, cast(rank as int) as rank from r"),
    "j17_bm25": (bm25, f"with {CTE} select query_id, id, score, cast(rank as int) as rank from b"),
    "j16_dense": (dense, f"with {CTE} select query_id, id, cast(rank as int) as rank from d"),
    "j18_rank_fusion": (fused, f"with {CTE} select query_id, id, score, cast(rank as int) as rank from f"),
    "ag14_recall_mrr_segments": (recall, RECALL_SQL),
    "ag16_confusion": (confusion, CONFUSION_SQL),
    "ag17_dispersion": (dispersion, DISPERSION_SQL),
    "ag18_shares": (shares, "select source, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct from documents group by source"),
    "r10_siblings": (siblings, SIBLINGS_SQL),
    "w20_context_budget": (context, CONTEXT_SQL),
    "pf1_chunk_filter": (filters, "select doc_id as id, cast(trunc(n_chars / 800) as int) as end_page from documents where lang = 'en' and trunc(n_chars / 800) <= 4 and contains(text, 'the') and contains(text, 'and') and not contains(text, 'License')"),
    "w3_parts_and_seq": (parts, "select l_orderkey, l_linenumber, l_partkey, cast(row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as part_index, count(*) over (partition by l_orderkey, l_returnflag) as part_total, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as seq from lineitem"),
}
