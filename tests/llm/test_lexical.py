from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from logloom.llm import lexical
from tests.llm.texts import SCHEMA, documents, rows_of, sentence

ITEMS = "item_id long, text string"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(lexical.TERM, text or "")]


def brute(docs, items, top=lexical.TOP):
    docs = [(r.doc_id, words(r.text)) for r in docs]
    docs = [(i, w) for i, w in docs if w]
    n, terms = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in {(r.item_id, r.text) for r in items}:
        scores = []
        for i, w in docs:
            m = 100 - 25 + 25 * len(w) * n // terms
            score = 0
            for x in words(text):
                if tf := w.count(x):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def items_of(spark, docs, count=40):
    rng = random.Random(3)
    texts = [r.text for r in docs if r.text and len(r.text.split()) > 8]
    rows = [(i, " ".join(rng.sample(rng.choice(texts).split(), 6)) + " é tie x X w1") for i in range(count)]
    rows += [(100, None), (101, " .,"), (102, "unheard"), (None, "tie one"), (1, "one two"), rows[0], rows[0], (103, "tie " * 50 + "漢")]
    return spark.createDataFrame(rows, ITEMS).repartition(3)


@pytest.mark.parametrize("size", [lexical.SHARD, 300])
def test_equal_to_brute_force(spark, monkeypatch, size):
    """Also with many shards and blocks of queries, where heaps carry over from shard to shard."""
    monkeypatch.setattr(lexical, "SHARD", size)
    if size == 300:
        monkeypatch.setattr(lexical, "QUERY_BYTES", 600)
        monkeypatch.setattr(lexical, "BLOCK", 4)
    docs = documents(spark, rows=200).repartition(2)
    items = items_of(spark, docs.collect())
    want = brute(docs.collect(), items.collect())
    assert rows_of(lexical.ranked(docs, items)) == want
    assert len(want) > 400 and any(i is None for _, _, i, _ in want)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 7)], "doc_id int, text string, key int, score int")
    items = spark.createDataFrame([("x", "b c", 1)], "item_id string, text string, id int")
    assert lexical.ranked(docs, items).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "int"), ("score", "bigint")]
    assert lexical.ranked(docs, items).collect() == [("x", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs.where("doc_id = 2"), items.limit(0)).collect() == []


def test_blocks_are_rejected_before_they_are_opened():
    """A rare term of high weight fixes the last score; of a frequent one only blocks of candidates are decoded."""
    rng = np.random.default_rng(1)
    common, rare = np.uint64(1), np.uint64(2)
    hashes = [np.concatenate(([common], rng.integers(10, 2**60, 40, np.uint64))) for _ in range(5000)]
    for at in (700, 701, 4000):
        hashes[at] = np.concatenate((hashes[at], [rare]))
    batch = lexical.shard(list(range(5000)), hashes, 5000, sum(map(len, hashes)))
    part = lexical.Shard(*(c[0].as_buffer() for c in batch.columns))
    lists, weights = np.searchsorted(part.terms, [common, rare]), np.array([3, 8000])
    docs, scores = part.search(lists, weights, 1)
    assert len(docs) == 5000
    least = int(np.sort(scores)[-3])
    part = lexical.Shard(*(c[0].as_buffer() for c in batch.columns))
    docs, scores = part.search(lists, weights, least)
    assert docs.tolist() == [700, 701, 4000] and len(part.decoded) == 1 + 2
    assert part.search(lists, weights, 10**12)[0].tolist() == []


def test_lengths_and_counts_beyond_a_byte(spark):
    rng = random.Random(2)
    rows = [(1, "deep " * 70_000, "en", "s", 1), (2, "deep " * 300 + "x", "en", "s", 1), (3, sentence(rng, 30) + " deep", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(1, "deep x"), (2, "x")], ITEMS)
    assert rows_of(lexical.ranked(docs, items)) == brute(docs.collect(), items.collect())
    assert lexical.scales(np.array([10**9]), 10**11, 10**12).tolist() == [75 + 25 * 10**9 * 10**11 // 10**12]
