import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import scratch

BIG = "ü" * 700
ROWS = [(1, "http://a/ b\r\n", BIG), (2, None, BIG), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", BIG + "x"), (None, "u", BIG), (7, "u", BIG + "x"), (8, "u", "1f8b\r\n\r\n" * 3)]


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        visit = len(data) >= 1000 and first is not None and page_id != first and sum((h or "") == (html or "") for _, _, h in rows) > 1
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", first if visit else None))
    return out


def write(spark, rows):
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), path)
    return path


def result(frame):
    number = lambda x: int(x.rsplit(":", 1)[1]) if x and not x.endswith(":") else None
    return [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in frame.collect()]


def test_round_trip_over_any_split(spark):
    path = write(spark, ROWS)
    for split in (64, 301, 1 << 20):
        frame = warc.read(spark, path, split)
        assert sorted(map(str, result(frame))) == sorted(map(str, expected(ROWS)))
        assert {bytes(r.payload).decode() for r in frame.collect() if r.payload is not None} == {h or "" for p, _, h in ROWS if p != 1}


def test_files_are_plain_gzip(spark):
    path = write(spark, ROWS).removeprefix("file:")
    data = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.startswith("part-"))
    assert data.count(b"WARC/1.1\r\n") == len(ROWS)


def test_empty_table(spark):
    assert warc.read(spark, write(spark, [])).count() == 0


def test_false_magic_and_long_members(tmp_path):
    record = warc.record("urn:page:1", "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    junk = warc.MAGIC + b"\x00" * 40 + gzip.compress(b"no record at all") + warc.MAGIC
    long = warc.member(b"WARC/1.1\r\n" + b"x" * (17 << 20))
    assert long[-1] == 0 and long.endswith(warc.EMPTY)
    data = junk + warc.member(record) + long + warc.member(record)
    file = tmp_path / "a.warc.gz"
    file.write_bytes(data)
    found = []
    for a in range(0, len(data), 50):
        with open(file, "rb") as f:
            found += [(at, len(body)) for at, body in warc.members(f, len(data), a, min(len(data), a + 50))]
    assert [n for _, n in found] == [len(record), (17 << 20) + 10, len(record)]
    assert warc.parse(record)["payload"] == b"payload"


def test_a_store_that_only_hadoop_knows(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./w", f"file://{tmp_path}")
    path = "viewfs://tests/w/archive"
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    assert sorted(map(str, result(warc.read(spark, path)))) == sorted(map(str, expected(ROWS)))


def test_a_member_that_is_cut_off(spark, tmp_path):
    record = warc.member(warc.record("urn:page:1", "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None))
    (tmp_path / "a.warc.gz").write_bytes(record + record[: len(record) // 2])
    assert result(warc.read(spark, f"file:{tmp_path}")) == [(1, 7, hashlib.sha1(b"payload").hexdigest(), "response", None)]
