"""A model is loaded once by a worker; images are read as they were drawn; layout trees in SQL."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import models, service
from tessera.plans.index_pack import png
from tessera.sources import images


def test_a_worker_loads_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")
        return 7

    def apply(model, x, y):
        return x * model + y

    scaled = models.per_worker(f"test {folder}", load, apply, "bigint")
    rows = spark.range(4000).repartition(12)
    for _ in range(3):
        assert rows.select(scaled(F.col("id"), F.col("id")).alias("z")).agg(F.sum("z")).first()[0] == 8 * sum(range(4000))
    loads = [len(open(f"{folder}/{pid}").read()) for pid in os.listdir(folder)]
    assert loads and set(loads) == {1}
    assert len(loads) <= 12  # a load for each of 72 tasks, were they loaded by task


def test_embed_by_a_given_model(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, None), (3, " . ")], "id long, content string")
    assert {r.id for r in service.embed(rows).collect()} == {1}
    length = models.per_worker("length", lambda: 2.0, lambda m, terms: terms.map(lambda t: [m * len(t)]), "array<double>")
    assert [(r.id, list(r.vector)) for r in service.embed(rows, length).collect()] == [(1, [6.0])]


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def drawn(pixels, depth, colour, kind, palette=b""):
    """A PNG of rows of channel values, each row filtered as kind says."""
    height, width = pixels.shape[:2]
    flat = pixels.reshape(height, -1)
    if depth == 16:
        rows = np.stack([flat, np.full_like(flat, 9)], -1).reshape(height, -1).astype(np.uint8)
    elif depth == 8:
        rows = flat.astype(np.uint8)
    else:
        bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
        rows = np.packbits(bits.reshape(height, -1).astype(np.uint8), axis=1)
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", np.zeros(rows.shape[1], np.int64)
    for row in rows.astype(np.int64):
        left, corner = np.zeros_like(row), np.zeros_like(row)
        left[step:], corner[step:] = row[:-step], above[:-step]
        p = left + above - corner
        near = np.abs(np.stack([p - left, p - above, p - corner])).argmin(0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    packed = zlib.compress(out)
    return images.PNG + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_pixels(kind, monkeypatch):
    monkeypatch.setattr(images, "CHUNK", 50)
    draw = np.random.default_rng(kind)
    for depth, colour, channels, shown in ((8, 0, 1, 1), (8, 2, 3, 3), (8, 6, 4, 3), (8, 4, 2, 1), (16, 2, 3, 3)):
        pixels = draw.integers(0, 256, (13, 17, channels))
        data = drawn(pixels, depth, colour, kind)
        assert images.size(data) == (17, 13)
        assert images.png_deviation(data) == pytest.approx(pixels[:, :, :shown].std())
    table = draw.integers(0, 256, (4, 3)).astype(np.uint8)
    pixels = draw.integers(0, 4, (5, 9, 1))
    assert images.png_deviation(drawn(pixels, 2, 3, kind, table.tobytes())) == pytest.approx(table[pixels[:, :, 0]].std())
    pixels = draw.integers(0, 2, (5, 9, 1))
    assert images.png_deviation(drawn(pixels, 1, 0, kind)) == pytest.approx((pixels * 255).std())


def test_image_files(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 333, 444) + b"\x01\x01\x11\x00"
    files = {"a.png": png(420, 310, 10, 200), "b.jpg": jpeg, "c.txt": b"no image", "d.png": png(20, 20, 1, 9)[:60]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    rows = read.union(spark.createDataFrame([("gone", None), ("e.png", b"")], "path string, content binary"))
    got = {r.path: tuple(r)[1:] for r in images.image_stats(rows).collect()}
    assert got["a.png"] == (True, len(files["a.png"]), 420, 310, 95.0)
    assert got["b.jpg"] == (True, len(jpeg), 444, 333, 0.0)
    assert got["c.txt"][2:] == (0, 0, 0.0) and got["d.png"][2:4] == (20, 20) and got["e.png"] == (True, 0, 0, 0, 0.0)
    assert got["gone"] == (False, 0, 0, 0, 0.0)


def test_layout_trees(spark):
    deep = '{"kids":[' * 900 + '{"content":"low"}' + "]}" * 900
    odd = '[{"content": 7, "page number": "x", "bounding box": 3, "kids": 5}, "text", {"kids": [null, {"content": "in", "heading level": 2}]}]'
    trees = spark.createDataFrame([(1, deep), (2, odd), (3, "{"), (4, None), (5, ""), (6, "3")], "doc long, tree string")
    got = sorted(tuple(r) for r in sources.layout_nodes(spark, trees).select("doc", "id", "depth", "level", "content").collect())
    assert [(d, i, deep_, c) for d, i, deep_, _, c in got] == [(1, 0, 900, "low"), (2, 0, 0, "7"), (2, 1, 1, "in")]
    sources.register_functions(spark)
    trees.createOrReplaceTempView("some_trees")
    assert spark.sql("select doc, n.content from some_trees, lateral layout_nodes(tree) n").count() == 3
