"""Queries of the vector index, of layout trees and of images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera import shared
from tessera.functions import text
from tessera.operators import vectors as vx
from tessera.plans.base import frame, table
from tessera.sources import images, register_functions


def _rows(spark, sf_dir, vector="embedding"):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("document_id"), F.expr(vector).alias("vector"))


def uploaded(spark, sf_dir):
    """An index of vectors turned about, into which the documents below 7 are uploaded as they are, twice, and document 8 with every second vector alone."""
    path = shared.path(spark, "index")
    vx.create(_rows(spark, sf_dir, "reverse(embedding)"), path)
    for _ in range(2):
        vx.upload(_rows(spark, sf_dir).filter("cast(document_id as int) < 7"), path)
    vx.upload(_rows(spark, sf_dir).filter("document_id = '8' and id % 2 = 0"), path)
    return vx.stored(spark, path).select("id", "document_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s * 0.5 + x), 6).alias("digest"))


UPLOADED_SQL = """
select vec_id as id, label::varchar as document_id, round(list_reduce(list_prepend(0.0::double, case when label < 7 or label = 8 then embedding::double[] else list_reverse(embedding::double[]) end), lambda s, x: s * 0.5 + x), 6) as digest
from embeddings where label <> 8 or vec_id % 2 = 0
"""


def nearest(spark, sf_dir):
    """The ten nearest of every twentieth vector by an exact search of the index."""
    path = shared.path(spark, "index")
    vx.create(_rows(spark, sf_dir), path)
    asked = _rows(spark, sf_dir).filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return vx.search(asked, path, 10, probes=4, exact=True).select("query_id", "id", "rank")


NEAREST_SQL = """
with s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0)
select query_id, id, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s qualify rank <= 10
"""

#: A tree for each document: a title with two paragraphs below it, one of them under a chain of nodes without text; some are broken or null.
TREES = """
select doc_id as doc, case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then '{"kids": [' else concat('{"kids": [{"content": "', source, '", "page number": ', cast(doc_id % 9 as string), ', "heading level": 1, "bounding box": [10.5, 1, 2, ', cast(doc_id % 700 as string), '], "kids": [',
  repeat('{"kids": [', cast(doc_id % 60 as int)), '{"content": "', lang, '", "bounding box": []}', repeat(']}', cast(doc_id % 60 as int)), ', {"content": "", "page number": 5}, {"page number": 3, "content": "n', cast(n_chars as string), '"}]}]}') end as tree
from documents
"""


def nodes(spark, sf_dir):
    register_functions(spark)
    frame(spark, sf_dir, TREES).createOrReplaceTempView("layout_trees")
    return spark.sql("select doc, n.page, n.id, n.depth, n.x0, n.y1, n.level, n.content from layout_trees, lateral layout_nodes(tree) n")


NODES_SQL = """
with d as (select *, cast(doc_id % 60 as int) as deep from documents where doc_id % 11 <> 0 and doc_id % 13 <> 0)
select doc_id as doc, cast(doc_id % 9 as int) as page, 0 as id, 1 as depth, 10.5::double as x0, (doc_id % 700)::double as y1, 1 as level, source as content from d
union all select doc_id, null, 1, 2 + deep, null, null, null, lang from d
union all select doc_id, 3, 2, 2, null, null, null, 'n' || n_chars from d
"""


def png(width: int, height: int, left: int, right: int, kind: int = 0) -> bytes:
    """A grey image of two halves, with PNG's row filter 0, 1 or 2."""
    row = np.repeat(np.array([left, right], np.uint8), width // 2)
    first = np.diff(row, prepend=np.uint8(0)) if kind == 1 else row
    rest = first if kind != 2 else np.zeros_like(row)
    pixels = bytes([kind]) + first.tobytes() + (bytes([kind]) + rest.tobytes()) * (height - 1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"tEXt", b"Comment\0" + b"x" * 60) + part(b"IDAT", zlib.compress(pixels)) + part(b"IEND", b"")


def image_files(spark, sf_dir):
    """A drawn image for each supplier, every seventh of which is missing."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [None if k % 7 == 0 else png(int(w), int(h), int(a), int(b), int(k % 3)) for k, w, h, a, b in zip(f.k, f.w, f.h, f.a, f.b)]
            yield pd.DataFrame({"path": f.k.astype(str), "content": made})

    drawn = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "(s_suppkey % 40) * 20 + 2 as w", "(s_suppkey * 7 % 45) * 15 + 2 as h", "s_suppkey * 31 % 256 as a", "s_suppkey * 17 % 256 as b")
    return drawn.mapInPandas(draw, "path string, content binary")


def image_stats(spark, sf_dir):
    found = images.image_stats(image_files(spark, sf_dir))
    verdict = text.image_verdict(F.col("present"), F.col("size"), F.col("width"), F.col("height"), F.col("stddev"))
    return found.select(F.col("path").cast("bigint").alias("s_suppkey"), "width", "height", F.round("stddev", 6).alias("stddev"), verdict.alias("verdict"))


IMAGES_SQL = """
with s as (select s_suppkey, s_suppkey % 7 <> 0 as present, (s_suppkey % 40) * 20 + 2 as width, (s_suppkey * 7 % 45) * 15 + 2 as height, abs(s_suppkey * 31 % 256 - s_suppkey * 17 % 256) / 2 as stddev from supplier)
select s_suppkey, case when present then width else 0 end as width, case when present then height else 0 end as height, round(case when present then stddev else 0 end, 6) as stddev,
  case when not present then 'not_exists' when width < 10 or height < 10 then 'too_small' when width < 400 or height < 300 then 'below_min' when width / height >= 10 then 'too_wide' when height / width >= 10 then 'too_tall' when stddev > 0 and stddev < 10 then 'flat' else 'ok' end as verdict from s
"""

QUERIES = {
    "sk9_vector_upload": (uploaded, UPLOADED_SQL),
    "r1_vector_index": (nearest, NEAREST_SQL),
    "sc11_layout_nodes": (nodes, NODES_SQL),
    "n2_image_stats": (image_stats, IMAGES_SQL),
}
