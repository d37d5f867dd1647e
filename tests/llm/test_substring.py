from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.llm import substring
from tests.llm.texts import SCHEMA, documents, rows_of


def brute(rows, width=13):
    split = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    first = {}
    for i, words in split:
        for at in range(len(words) - width + 1) if i is not None else ():
            window = tuple(words[at:at + width])
            first[window] = min(i, first.get(window, i))
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - width + 1) if i is not None else ():
            if first[tuple(words[at:at + width])] < i:
                gone |= set(range(at, at + width))
        kept = [w for at, w in enumerate(words) if at not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_equal_to_brute_force(spark):
    docs = documents(spark).withColumnRenamed("lang", "places").withColumn("key", F.lit(1))
    want = brute(docs.collect())
    assert sum(r[2] for r in want) > 1000
    assert rows_of(substring.digests(docs, log2_width=20)) == want


def test_a_full_sketch_loses_nothing(spark):
    docs = documents(spark, seed=8)
    assert rows_of(substring.digests(docs, log2_width=6, bucket=500)) == brute(docs.collect())


def test_small_stretches(spark, monkeypatch):
    docs = documents(spark, seed=9)
    monkeypatch.setattr(substring, "GATHER", 64)
    texts = docs.selectExpr("doc_id id", "hash(text) key", "text")
    found = substring.hits(texts, log2_width=20)
    hit = {(r.id, r.key) for r in found.collect()}
    assert {i for i, _ in hit} == {r[0] for r in brute(docs.collect()) if r[2]}


def test_equal_ids_of_different_texts(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (1, "new " + passage), (2, "x " + passage), (2, "other words")], "doc_id long, text string")
    assert rows_of(substring.digests(docs, log2_width=20)) == brute(docs.collect())


def test_texts_are_cut_in_place(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.createDataFrame([(1, passage, "a"), (2, f"  first\n{passage}\n last  one ", "b"), (3, None, "c"), (4, " as\tit  is ", "d")],
                                 "doc_id long, text string, places string")
    got = {r.doc_id: r.text for r in substring.deduplicated(docs, log2_width=20).collect()}
    assert got == {1: passage, 2: "  first\nlast  one ", 3: None, 4: " as\tit  is "}
    assert substring.deduplicated(docs, log2_width=20).schema == docs.schema


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.digests(none, log2_width=20).collect() == []
    assert substring.deduplicated(spark.createDataFrame([(1, None)], "doc_id long, text string"), log2_width=20).count() == 1


def test_columns_of_some_rows_are_unpacked():
    values = [np.array([1, 2], "<i8"), np.array([3], "<i8"), np.empty(0, "<i8")]
    blobs = {"id": [substring.pack(v, "<i8") for v in values], "key": [substring.pack(v, "<i4") for v in values],
             "place": [substring.pack(v, "<i4") for v in values]}
    table = pa.table({name: pa.array([None] * 3 if name in "wv" else blobs[name], pa.binary()) for name in substring._NAMES})
    assert [c.tolist() for c in substring._columns(table, 2, np.array([2, 0]))] == [[1, 2]] * 3
    assert [c.tolist() for c in substring._columns(table, 2)] == [[1, 2, 3]] * 3


def test_settled_sorts_the_columns_it_is_given():
    columns = [np.array(c) for c in ([5, 4, 5], [0, 0, 0], [9, 1, 3], [1, 1, 1], [7, 8, 6])]
    sent, hit = substring._settled(columns)
    assert sent is columns and sent[2].tolist() == [1, 3, 9] and hit.tolist() == [False, False, True]
