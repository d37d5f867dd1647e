from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import simhash
from tests.llm.texts import SCHEMA, documents, rows_of, sentence


def fingerprint(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes = [0] * 64
    for at, word in enumerate(words):
        term = xxhash.xxh64_intdigest(word, 42)
        if at + 1 < len(words):
            term = xxhash.xxh64_intdigest(words[at + 1], term)
        for bit in range(64):
            votes[bit] += 1 if term >> bit & 1 else -1
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def brute(rows, radius=simhash.RADIUS):
    rows = [(r.doc_id, r.text or "") for r in rows]
    prints = {text: fingerprint(text) for _, text in rows}
    order = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))[::-1]
    texts = {i: max({t for x, t in rows if x == i}, key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))) for i in order}
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    out = []
    for i, text in rows:
        cut, other = len(text) // 3, texts[after[i]]
        edit = text[:len(text) - cut] + other[:cut]
        own, changed = prints[text], fingerprint(edit)
        same = [x for x, t in rows if prints[t] == own and x is not None]
        near = sum((prints[t] ^ own).bit_count() <= radius for _, t in rows) - 1
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}",
                    1 - (own ^ changed).bit_count() / 64, 1 - (own ^ prints[other]).bit_count() / 64,
                    min(same, default=None), near))
    return sorted(out, key=repr)


def test_equal_to_brute_force(spark):
    rng = random.Random(5)
    base = sentence(rng, 900, 10_000).split()
    near = [" ".join(base[:at] + ["changed"] + base[at + 1:]) for at in range(0, 900, 30)]
    rows = [(5000 + 7 * i, t, "en", "s", 1) for i, t in enumerate(near)]
    rows += [(9000, "𝄞 É é x " * 70, "en", "s", 1), (-3, "a" * 50_000, "en", "s", 1), (0, "another text of id 0", "en", "s", 1)]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    want = brute(docs.collect())
    assert rows_of(simhash.compared(docs)) == want
    assert sum(w[8] > 0 for w in want) > 40 and len({w[3] for w in want}) > 100


def test_clashing_columns_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "x y", 1, 2), ("a", None, 3, 4)], "name string, body string, own int, id int")
    assert rows_of(simhash.compared(docs, "name", "body")) == sorted(
        [("b", 3, hashlib.sha256(b"x y"[:2]).hexdigest(), f"{fingerprint('x y'):016x}", f"{fingerprint('x '):016x}",
          1 - (fingerprint("x y") ^ fingerprint("x ")).bit_count() / 64, 1 - fingerprint("x y").bit_count() / 64, "b", 0),
         ("a", 0, hashlib.sha256(b"").hexdigest(), "0" * 16, "0" * 16, 1.0, 1 - fingerprint("x y").bit_count() / 64, "a", 0)], key=repr)
    one = spark.createDataFrame([(4, "uno dos tres", "es", "s", 1)], SCHEMA)
    assert rows_of(simhash.compared(one)) == brute(one.collect())
    assert simhash.compared(one.limit(0)).collect() == []


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (2, 4), (1, 5), (0, 1)])
def test_tables_find_all_within_the_radius_once(spark, radius, blocks):
    rng = random.Random(radius)
    found = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        found.add(base)
        for _ in range(12):
            other = base
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                other ^= 1 << bit
            found.add(other)
    values = sorted(map(signed, found))
    want = sorted((a, b) for n, a in enumerate(values) for b in values[n + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)
    df = spark.createDataFrame([(v,) for v in [*values, *values[:5]]], "fingerprint long").repartition(3)
    assert sorted(tuple(r) for r in simhash.near(df, radius, blocks).collect()) == want
    assert radius == 0 or len(want) > 20


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(1, 6), st.integers(0, 10**6))
def test_close_values_share_a_key(value, radius, seed):
    rng, other = random.Random(seed), value
    for bit in rng.sample(range(64), radius):
        other ^= 1 << bit
    assert any((value ^ other) & mask & (1 << 64) - 1 == 0 for mask in simhash.tables(radius, radius + 3))


def test_bad_tables():
    with pytest.raises(ValueError, match="radius 4"):
        simhash.tables(4, 4)
