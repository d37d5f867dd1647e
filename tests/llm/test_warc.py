from __future__ import annotations

import hashlib
import random

import zstandard
from pyspark.sql import functions as F

from logloom.llm import store, warc
from tests.llm.texts import rows_of, sentence

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    rng = random.Random(4)
    texts = [f"<html>{sentence(rng, 300)}</html>" for _ in range(60)]
    rows = [(i, f"https://a.example/{i} é\n", t, "x") for i, t in enumerate(texts)]
    rows += [(100 + i, None, texts[3], "x") for i in range(5)] + [(200, "u", "small", "x"), (201, "u", "small", "x")]
    rows += [(202, "u", None, "x"), (203, "u", "", "x"), (204, "u", "z" * 3_000_000, "x"), (205, "u", "é" * 500, "x"),
             (206, "u", "é" * 500, "x"), (207, "u", "é" * 499, "x"), (208, "u", "é" * 499, "x")]
    rows += [(None, None, texts[5], None), (None, "n", "q" * 2000, None), (None, "n", "q" * 2000, None), rows[7], rows[7]]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows):
    out, owner = [], {}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            owner[data] = max(page_id, owner.get(data, page_id))
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        refers = owner.get(data) if owner.get(data) != page_id else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_written_and_read_back(spark):
    rows, df = pages(spark)
    archives = warc.write_archives(df, archive_bytes=20_000)
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == len(rows)
    read = warc.read_archives(archives, payloads=True)
    assert rows_of(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute(rows)
    responses = read.where("record_type = 'response'").selectExpr("page_id", "cast(payload as string) html")
    stored = {r.page_id: r.html for r in responses.collect() if r.page_id is not None}
    assert all(stored[i] == (html or "") for i, _, html, _ in rows if i in stored)


def test_files_are_plain_zstandard_frames(spark):
    rng = random.Random(5)
    texts = [f"<p>{sentence(rng, 200, 50)}</p>".encode() for _ in range(200)]
    records = [warc.record(i, "u", t, hashlib.sha1(t).hexdigest(), None) for i, t in enumerate(texts)]
    data, starts = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    assert size > 1024 and starts[0] == 8 + size
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    assert own.decompress(data[starts[9]:starts[10]]) == records[9] == warc.record_at(data, starts[9])
    assert list(warc.records_of(data)) == records
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < alone


def test_archives_are_read_by_several_tasks(spark):
    _, df = pages(spark)
    archives = warc.write_archives(df, archive_bytes=5_000)
    assert archives.count() > 20
    tasks = warc.read_archives(archives).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_of_lost_attempts_are_not_read(spark):
    _, df = pages(spark)
    archives = warc.write_archives(df)
    path = archives.first().path
    store.write_file(path.rpartition("/")[0], "left.warc.zst", b"half")
    assert warc.read_archives(archives).count() == df.count()


def test_no_pages(spark):
    archives = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert archives.collect() == [] and warc.read_archives(archives).collect() == []
